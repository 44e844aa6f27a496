"""A small labelled URL table: hosts and paths of the kinds that a corpus keeps out (1) and takes in (0).

Written by hand for this library. Every host is invented and stands for a kind: gambling, adult, pills, loans, counterfeit
goods, downloads of cracked software, trackers and advert servers, link farms, phishing, against encyclopedias, news,
universities, government, libraries, documentation, science, blogs, recipes, health and culture, in four languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Labelled hosts with their paths.
BLOCK = """
lucky-casino-bonus.example/slots/free-spins
win-big-poker.example/signup?ref=77
bestbet365.example/sports/betting/odds
jackpot-roulette-online.example/casino/play
apuestas-casino.example/tragaperras/gratis
wetten-casino-bonus.example/spielautomaten
paris-casino-bonus.example/machines-a-sous
mega-slots.example/bonus/no-deposit
bingo-win-cash.example/play-now
online-lotto-winner.example/claim-prize
hot-xxx-videos.example/free/porn/1
sexy-cams-live.example/girls/chat
adult-dating-tonight.example/hookup
porno-gratis.example/videos/xxx
nude-pics.example/gallery/sex
escort-girls-city.example/xxx/book
sex-kontakte.example/girls/live
rencontre-coquine.example/sexe/gratuit
cheap-viagra-pills.example/buy/no-prescription
discount-pharmacy-meds.example/order/cialis
buy-xanax-online.example/pills/cheap
weight-loss-miracle.example/diet-pills/buy-now
male-enhancement.example/pills/order
canadian-meds-cheap.example/viagra
steroids-shop.example/buy/anabolic
fast-payday-loans.example/apply-now/bad-credit
quick-cash-loan.example/instant-approval
make-money-fast.example/work-from-home
get-rich-crypto.example/bitcoin/double-your-money
forex-profit-signals.example/join-vip
credit-repair-cheap.example/free-offer
binary-options-win.example/signup/bonus
kredit-sofort-billig.example/ohne-schufa/angebot
credito-rapido.example/dinero/oferta
replica-watches-cheap.example/rolex/sale
fake-handbags-outlet.example/buy/discount-80
cheap-sneakers-outlet.example/sale/buy-now
discount-sunglasses.example/outlet/cheap
luxury-replica-bags.example/shop/sale
essay-writing-cheap.example/order-now
buy-followers-likes.example/instagram/cheap
cheap-seo-backlinks.example/buy/links
free-crack-downloads.example/keygen/serial
warez-full-version.example/download/crack
torrent-movies-free.example/download/hd-rip
free-movies-stream.example/watch/full-hd
mp3-download-free.example/album/rar
nulled-scripts.example/plugin/download-free
serial-keygen.example/crack/patch
hack-game-coins.example/generator/free
ads.tracker-pixel.example/click?id=9
adserver.banner-ads.example/serve/banner
track.click-affiliate.example/redirect/offer
popunder-ads.example/pop/click
clicktrack.example/aff/c?offer=12
affiliate-offers.example/go/landing
banner-exchange.example/ad/click
doubleclicks-ads.example/adframe/track
link-directory-free.example/submit/links
best-links-4u.example/page/links/99
web-directory-top.example/add-url
free-article-spam.example/seo/backlink
cheap-domains-expired.example/parking/buy
parked-domain-sale.example/offer
paypa1-secure-login.example/verify/account
account-verify-bank.example/login/update
secure-signin-update.example/confirm/password
apple-id-locked.example/unlock/verify
netbank-security-alert.example/login/verify
free-iphone-winner.example/claim-prize/now
gift-card-free.example/survey/claim
you-won-prize.example/claim/free
survey-rewards-cash.example/win/gift
free-vbucks.example/generator/claim
cheap-flights-deals-now.example/buy/offer?aff=3
coupon-deals-cheap.example/discount/offer
super-sale-cheap.example/buy-now/discount
angebote-billig-kaufen.example/rabatt/jetzt
ofertas-baratas.example/comprar/descuento
acheter-pas-cher.example/promo/soldes
hot-singles-near-you.example/chat/now
live-cam-chat.example/free/girls
psychic-reading-cheap.example/call-now
miracle-cure-pills.example/buy/now
www.billig-pillen.example/de/903.html
m.free-casino.example/fr/55?ref=x
www.cheap-meds-now.example/es/7061
blog.hot-deals-cheap.example/en/4.html
m.banner-track.example/en/3099?page=2&ref=x
www.click-ads.example/fr/812.html
m.poker-bonus.example/de/6120#top
www.xxx-cams.example/es/77?utm_source=feed
"""
ALLOW = """
encyclopedia.example/wiki/History_of_astronomy
en.encyclopedia.example/wiki/River
de.enzyklopaedie.example/wiki/Geschichte
fr.encyclopedie.example/wiki/Histoire
es.enciclopedia.example/wiki/Historia
dictionary.example/entry/language
news-daily.example/2021/05/world/election-results
times-herald.example/2019/11/economy/inflation-report
morning-post.example/politics/parliament-debate
nachrichten.example/politik/bundestag-debatte
journal-du-matin.example/monde/article-politique
noticias.example/mundo/elecciones-resultados
local-gazette.example/2020/03/city-council-meeting
science-journal.example/articles/vol12/climate-model
nature-review.example/papers/protein-structure
preprints.example/abs/2001.01234
physics-letters.example/article/quantum-fields
medical-journal.example/study/heart-disease
university.example/department/history/courses
cs.university.example/lectures/algorithms/notes
math.college.example/people/faculty
uni-bibliothek.example/katalog/forschung
universite.example/recherche/laboratoire
universidad.example/facultad/investigacion
library.example/catalog/collections/manuscripts
museum.example/exhibitions/roman-art
archive.example/details/old-letters
national-archives.example/records/census-1901
gov.example/agency/health/guidance
parliament.example/bills/2022/education-act
statistics.gov.example/reports/population
city.gov.example/services/waste-collection
ministerium.example/themen/bildung
mairie.example/services/urbanisme
ayuntamiento.example/servicios/cultura
court.example/judgments/2018/appeal
docs.software.example/guide/installation
developer.example/reference/api/strings
python-tutorial.example/tutorial/functions
database.example/docs/current/indexes
linux-manual.example/man/grep
opensource.example/project/readme
code-forum.example/questions/how-to-parse-dates
standards.example/specification/http
engineering-blog.example/posts/scaling-storage
gardening-blog.example/2018/06/growing-tomatoes
travel-diary.example/posts/walking-in-the-alps
teacher-notes.example/blog/reading-in-class
philosophy-essays.example/essay/free-will
book-reviews.example/review/nineteenth-century-novel
poetry.example/poems/autumn
literature.example/authors/biography
cooking.example/recipes/bread-with-seeds
kochen.example/rezepte/brot-backen
cuisine.example/recettes/soupe-de-legumes
recetas.example/cocina/pan-de-maiz
health-information.example/conditions/asthma
hospital.example/patients/advice/vaccination
nutrition.example/article/vitamins-and-diet
public-health.example/guidance/hygiene
weather.example/forecast/region/north
astronomy-club.example/observing/moon-phases
birdwatching.example/species/robin
geology.example/rocks/granite
wildlife.example/animals/otter
climate.example/data/temperature-record
history-society.example/articles/medieval-trade
genealogy.example/families/records
maps.example/place/river-valley
film-studies.example/essays/silent-cinema
music-theory.example/lessons/harmony
orchestra.example/concerts/programme
theatre.example/plays/synopsis
chess-club.example/openings/lesson
football-history.example/season/1966
school.example/curriculum/mathematics
kindergarten.example/eltern/informationen
charity.example/about/annual-report
church-history.example/parish/register
newspaper.example/opinion/letters
economics.example/working-papers/trade
law-review.example/articles/contract
veterinary.example/advice/dogs
railway-history.example/lines/branch
www.tageblatt.example/de/4711.html
m.wetterdienst.example/de/88#top
blog.handwerk.example/de/2093?page=2&ref=x
www.gazette.example/fr/3120.html
m.meteo.example/fr/715
blog.jardin.example/fr/6204?utm_source=feed
www.diario.example/es/5512.html
m.clima.example/es/19/
blog.huerto.example/es/8840?utm_source=feed
www.reader.example/en/7034.html
m.weekly.example/en/266#top
blog.sketches.example/en/9157?page=2&ref=x
"""


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The table as (url, label): 1 is block. No Python runs on the executors."""
    rows = [F.struct(F.lit(f"https://{x}").alias("url"), F.lit(k).alias("label")) for k, part in ((1, BLOCK), (0, ALLOW)) for x in part.split()]
    return spark.range(1).select(F.inline(F.array(*rows)))
