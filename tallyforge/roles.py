"""Which columns are the target, the entity, keys, dates and identities: decided from names alone."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

# Names and name parts by role.
TARGETS = ("target", "label", "y", "class", "output", "default_flag", "fraud", "is_fraud", "churn", "bad_flag")
ENTITIES = (
    "customer_id", "entity_id", "user_id", "client_id", "account_id", "cust_id", "applicant_id", "borrower_id", "loan_id", "application_id", "contract_id",
    "cif", "cif_id", "cif_no", "so_cif", "ma_cif", "cust_no", "cust_t24", "customer_no", "customer_number", "customer_t24", "t24_number", "t24_num", "client_no", "account_no",
    "ma_kh", "ma_khach", "ma_khach_hang", "ma_khach_hang_t24", "kh_code", "kh_ma", "id_kh", "ma_hd", "so_hd", "so_ho_so",
)
IDENTITIES = {
    "cif": ("cif", "cif_id", "cif_no", "so_cif", "ma_cif", "cust_no", "cust_t24", "customer_no", "customer_number", "customer_t24", "t24_number", "t24_num"),
    "phone": ("phone", "phone_number", "mobile", "dien_thoai", "so_dt", "so_dien_thoai"),
    "device": ("device", "device_id", "thiet_bi"),
    "national_id": ("national_id", "nid", "id_number", "id_no", "idnum", "cccd", "cmt", "cmnd", "so_cmnd", "so_cccd"),
}
LEAKS = ("future", "next", "forward", "ahead", "leakage")
DATE_PARTS = ("date", "dt", "time", "timestamp", "snap", "period", "month", "year", "week", "day")
DATE_NAMES = (
    "date", "dt", "datetime", "timestamp", "ts", "snap_dt", "snapshot", "observation_date", "report_date", "as_of", "as_of_date",
    "date_decision", "process_date", "month_id", "year_month", "period", "month", "cohort",
)
DATE_ENDS = ("date", "dt", "ts", "timestamp", "snap_dt", "snap", "month_id", "year_month")
MONEY_PARTS = ("amount", "amt", "balance", "income", "price", "count", "cnt", "num_", "qty", "quantity", "age")


@dataclass(frozen=True)
class Roles:
    target: str | None = None
    entity: str | None = None
    keys: tuple[str, ...] = ()
    date: str | None = None
    identities: tuple[str, ...] = field(default=())

    @property
    def protected(self) -> set[str]:
        return {c for c in (self.target, self.entity, self.date, *self.keys, *self.identities) if c}


def find_target(columns: Sequence[str], wanted: str | None = None) -> str | None:
    """The wanted name, exactly, then in another case; else the first known alias that is a column."""
    if wanted in columns:
        return wanted
    low = {c.lower(): c for c in columns}
    return next((low[name] for name in ((wanted or "").lower(), *TARGETS) if name in low), None)


def is_entity_name(name: str) -> bool:
    """``id`` as a word of the name, but not as the first of several: id_number is a document of a person."""
    first, *rest = name.lower().split("_")
    return "id" in rest or not rest and first == "id"


def find_entity(columns: Sequence[str], wanted: str | None = None) -> str | None:
    """The wanted name, else the first known one in the order of the columns, else the first that reads like an entity's key."""
    if wanted in columns:
        return wanted
    known = set(ENTITIES)
    return next((c for test in (lambda c: c.lower() in known, is_entity_name) for c in columns if test(c)), None)


def is_date_name(name: str) -> bool:
    """The strict test: a known name, or a known ending behind an underscore."""
    low = name.lower()
    return low in DATE_NAMES or low.endswith(tuple(f"_{end}" for end in DATE_ENDS))


def has_date_part(name: str) -> bool:
    """The loose test: a date word anywhere in the name."""
    return any(p in name.lower() for p in DATE_PARTS)


def identity_group(name: str) -> str | None:
    """Which kind of identity a column holds by its name."""
    return next((group for group, names in IDENTITIES.items() if name.lower() in names), None)


def leaks_by_name(columns: Sequence[str], target: str | None = None) -> list[str]:
    return [c for c in columns if c != target and any(w in c.lower() for w in LEAKS)]


def resolve(columns: Sequence[str], target: str | None = None, entity: str | None = None) -> Roles:
    t = find_target(columns, target)
    e = find_entity([c for c in columns if c != t], entity)
    rest = [c for c in columns if c not in (t, e)]
    return Roles(t, e, (), next((c for c in rest if is_date_name(c) and not identity_group(c)), None), tuple(c for c in rest if identity_group(c)))
