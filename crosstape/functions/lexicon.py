"""Word lists and patterns the text scores depend on."""

# Default finance lexicon and negators. Callers may pass their own tables.
POSITIVE = """
advance advanced advances award awarded bags beat beats benefit benefited best
better boost boosted breakthrough commissioned complete completed contract
contracts deliver delivered demand doubled efficient enhance enhanced exceed
exceeded exceeds expand expanded expansion favorable gain gained gains grew
grow growing growth high higher highest improve improved improvement improving
increase increased increases jump jumped launch launched lead leading maiden
milestone opportunity optimistic order orders outperform outperformed peak
positive premium profit profitable profits progress raise raised rally record
records recover recovered recovery reward rise rises rising robust rose secured
soar soared solid strength strengthen strong stronger strongest succeed success
successful surge surged surpassed turnaround upgrade upgraded upside win winning
wins won
""".split()

NEGATIVE = """
adverse adversely against arrears bankruptcy breach breached cancel cancelled
caution concern concerns crisis critical cut cuts decline declined declines
decrease decreased default defaults delay delayed delays deteriorate
deteriorated difficult diminished disappointing dispute downgrade downgraded
downturn drop dropped fail failed failure fall fallen falling fell fine fined
fraud halt halted hit impairment inability insolvency insolvent investigation
lawsuit liquidation litigation lose loses losing loss losses lost lower lowered
lowest miss missed misses negative penalty plunge plunged poor pressure probe
protest qualified reject rejected resign resignation resigned restructuring
shortfall shut shutdown slow slowdown slump slumped strike struggling
subdued suspend suspended suspension terminate terminated tumble tumbled
uncertain uncertainty unable weak weaker weakness worse worst write-off writeoff
""".split()

NEGATORS = """
no not never none cannot without fails failed lack lacks lacking barring absent nor
""".split()

# Words of company names that also fill ordinary market copy.
NAME_STOP = """
limited ltd ltd. the india indian company industries corporation corp enterprises & and
global international national group holdings technologies technology services systems
solutions products projects ventures resources trading markets market finance financial
capital power energy steel motors auto bank first new healthcare health pharma
pharmaceuticals cement textiles chemicals foods food metals mining hotels infra
infrastructure engineering electronics telecom media retail agro petro labs laboratories
constructions construction cables
""".split()

# Paths and titles of pages that are not stories.
NOT_STORY_PATH = r"(?i)/(tags?|topic|topics|quotes?|stocks?pricequote|share-price|company)/"
NOT_STORY_TITLE = (
    r"(?i)\b(share|stock)\s+price\b|\blive\s+today\b|\bquarterly\s+earnings\b|\bannual\s+report\s+analysis\b"
    r"|\bprice\s+live\b|\bstock\s+quote\b|\bshare\s+price\s+target\b|\bcompany\s+profile\b"
    r"|\bstock\s+research\s+report\b|\bltd\.?\s+[A-Z0-9]{3,}\s*$"
)

# Publisher spellings (flattened name -> name) and feed-key prefixes.
PUBLISHERS = {
    "moneycontrol": "Moneycontrol",
    "cnbctv18": "CNBCTV18",
    "mint": "Mint",
    "livemint": "Mint",
    "the economic times": "The Economic Times",
    "economictimes": "The Economic Times",
    "economic times": "The Economic Times",
    "business standard": "Business Standard",
    "business line": "Business Line",
    "thehindubusinessline": "Business Line",
    "the financial express": "The Financial Express",
    "financialexpress": "The Financial Express",
    "zee business": "Zee Business",
    "zeebiz": "Zee Business",
    "hindustan times": "Hindustan Times",
    "hindustantimes": "Hindustan Times",
    "business today": "Business Today",
    "businesstoday": "Business Today",
    "reuters": "Reuters",
    "news18": "News18",
    "investopedia": "Investopedia",
}
FEED_PREFIXES = {
    "et_": "The Economic Times",
    "livemint_": "Mint",
    "mc_": "Moneycontrol",
    "zeebiz": "Zee Business",
    "bs_": "Business Standard",
}
