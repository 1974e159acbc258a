"""Fixed values of the domain: cities, taxonomy, display groups, time window."""

from __future__ import annotations

from dataclasses import dataclass, field

WINDOW_DAYS = 184
SOURCE_TYPES = ("news", "police_press_release", "police_fir_list", "police_detection_report")
SOURCE_KINDS = ("news", "police")

# Ranking of point precision, best first.
PRECISION_ORDER = ("address", "police_station", "locality", "city")


@dataclass(frozen=True)
class City:
    id: str
    name: str
    aliases: tuple[str, ...]
    lat: float
    lng: float
    min_lat: float
    max_lat: float
    min_lng: float
    max_lng: float


# Centres and bounding boxes in WGS84 degrees.
CITIES = (
    City("delhi", "Delhi", ("delhi", "new delhi"), 28.6139, 77.209, 28.4, 28.89, 76.83, 77.35),
    City("bengaluru", "Bengaluru", ("bengaluru", "bangalore"), 12.9716, 77.5946, 12.8, 13.2, 77.4, 77.85),
    City("goa", "Goa", ("goa",), 15.4909, 73.8278, 14.89, 15.81, 73.66, 74.34),
)
CITY_IDS = tuple(c.id for c in CITIES)
CITY_BY_ID = {c.id: c for c in CITIES}


@dataclass(frozen=True)
class Group:
    id: str
    label: str
    color: str
    disabled: bool = False


# Display groups in display order.
GROUPS = (
    Group("violent", "Violent crime", "#e66767"),
    Group("harassment", "Harassment", "#d55181"),
    Group("scam", "Scam", "#d95926"),
    Group("transport", "Transport", "#3987e5"),
    Group("stay", "Stay", "#9085e9"),
    Group("safe", "Safe", "#199e70", disabled=True),
)
GROUP_IDS = tuple(g.id for g in GROUPS)
NO_GROUP_COLOR = "#9aa0a6"


@dataclass(frozen=True)
class Category:
    """``words`` is the body of a case-insensitive whole-word pattern; None matches nothing."""

    id: str
    group: str | None
    label: str
    words: str | None


# The ordered rules. The first rule that matches decides the category.
CATEGORIES = (
    Category("sexual_crime", "harassment", "Sexual crime / harassment",
             r"rape[ds]?|raping|gang-?rape[ds]?|molest\w*|sexual(ly)? (assault|harass|abus)\w*|harass(ed|ment|ing)|stalk(ed|ing|er)|eve-?teas\w*|acid attack|voyeur\w*|pocso|obscene|indecent"),
    Category("road_accident", "transport", "Road accident",
             r"accident|hit-and-run|hit and run|run over|mowed down|crash(ed|es)?|collid\w*|overturn\w*|rams?|rammed|skid(ded)?|drunk driving|mishap"),
    Category("murder", "violent", "Murder",
             r"murder\w*|killed|kills?|hacked to death|stabbed to death|beaten to death|bludgeoned|shot dead|strangled|throttled|dead body|body (found|recovered)|homicide|lynch\w*"),
    Category("shooting", "violent", "Shooting / firing",
             r"shot at|shoot\w*|firing|opened fire|gunshot|bullet"),
    Category("kidnapping", "harassment", "Kidnapping",
             r"kidnap\w*|abduct\w*|trafficking|ransom"),
    Category("cyber_fraud", "scam", "Cyber fraud",
             r"cyber\w*|online (fraud|scam)|digital arrest|phishing|otp|upi|sextortion|investment (fraud|scam)|trading (fraud|scam)|fake (app|website|call cent(re|er))|deepfake|task scam|part-time job scam"),
    Category("robbery", "harassment", "Robbery / dacoity",
             r"robb(ed|ery|er|ers|ing)|robs?|loot\w*|dacoit\w*|mugg(ed|ing|er)|waylaid|at knifepoint|at gunpoint|heist|home invasion"),
    Category("snatching", "harassment", "Snatching",
             r"snatch\w*|chain-?snatch\w*"),
    Category("assault", "harassment", "Assault / attempt to murder",
             r"assault\w*|attack(ed|s)?|stab(bed|bing|s)?|attempt to murder|thrashed|beaten|brawl|clash(ed|es)?|injur(ed|es)|road rage|domestic violence"),
    Category("extortion_organised_crime", "harassment", "Extortion / organised crime",
             r"extort\w*|gang(ster|sters)?|arms act|illegal (arms|weapons?)|pistol|country-made|organised crime|mcoca|kcoca"),
    Category("fraud", "scam", "Fraud / cheating",
             r"fraud\w*|cheat(ed|ing|s)?|dup(ed|ing)|scam\w*|conned|forg(ed|ery)|fake|swindl\w*|embezzl\w*|ponzi"),
    Category("drugs", None, "Drugs / smuggling",
             r"drugs?|narcotic\w*|ndps|ganja|cannabis|charas|heroin|smack|cocaine|mdma|hashish|peddl\w*|psychotropic|lsd|mephedrone|smuggl\w*"),
    Category("burglary_theft", None, "Burglary / theft",
             r"theft|thieves|thief|steal\w*|stole|stolen|burglar\w*|break into|break-in|broke into|house-?break\w*|pickpocket\w*|lifter"),
    Category("drowning", None, "Drowning", r"drown\w*"),
    Category("unnatural_death", None, "Unnatural death / suicide",
             r"suicide|found dead|unnatural death|found hanging|dies by suicide"),
    Category("public_safety", None, "Public safety incident",
             r"collapse[ds]?|nuisance|stampede|electrocut\w*|fire breaks out|blaze"),
    Category("other", None, "Other crime", None),
)

# Group overrides, tried in this order for the base groups scam and harassment.
STAY_WORDS = r"hotels?|resorts?|guest ?houses?|homestays?|hostels?|PGs?|paying guest|airbnb|lodges?|villas?|landlord|tenants?|accommodation|room rent|(flat|room|apartment|house) rental|booking (fraud|scam)"
TRANSPORT_WORDS = r"taxis?|cabs?|auto(-| )?rickshaws?|auto drivers?|uber|ola|rapido|bike (rental|taxi)|rent-a-(bike|car)|touts?|bus (conductor|driver)|railway station|trains?|metro"

# Headline prefilter.
ARREST_WORDS = r"arrest\w*|held|nabbed|booked|fir|detained|absconding|busted"
EXCLUDE_WORDS = r"court|hc|high court|supreme court|bail|verdict|sentenc\w*|convict\w*|acquit\w*|chargesheet\w*|hearing|plea|petition|judge|tribunal|opinion|editorial|minister|election|polls?|mla|mp|bjp|congress|aap|weather|rain"


@dataclass(frozen=True)
class Taxonomy:
    """Everything the classifier needs; pass another instance to replace the rules."""

    categories: tuple[Category, ...] = CATEGORIES
    fallback: str = "other"
    overridable: tuple[str, ...] = ("scam", "harassment")
    overrides: tuple[tuple[str, str], ...] = (("stay", STAY_WORDS), ("transport", TRANSPORT_WORDS))
    groups: tuple[Group, ...] = field(default=GROUPS)

    @property
    def category_ids(self) -> tuple[str, ...]:
        return tuple(c.id for c in self.categories)

    def base_group(self) -> dict[str, str]:
        return {c.id: c.group for c in self.categories if c.group}


TAXONOMY = Taxonomy()
CATEGORY_IDS = TAXONOMY.category_ids

# Title words that say nothing about which incident it is.
TITLE_STOP_WORDS = (
    "the", "a", "an", "in", "on", "at", "of", "for", "to", "by", "with", "from", "and", "or", "after", "over",
    "into", "as", "is", "was", "his", "her", "their", "its", "rs", "lakh", "crore", "police", "cops", "delhi",
    "bengaluru", "bangalore", "goa", "held", "arrested", "arrest", "man", "woman", "case", "booked", "news",
)

# Event grouping.
EVENT_WINDOW_DAYS = 2

# Names too vague to place a report, and police offices without a beat.
STOP_NAMES = (
    "nagar", "colony", "market", "village", "sector", "road", "main road", "city", "old", "new",
    "railway station", "bus stand", "extension", "layout", "block", "phase", "north", "south", "east", "west",
    "central", "india", "police", "station",
)
GENERIC_OFFICE_WORDS = r"delhi|bengaluru|bangalore|goa|commissioner|director|general|crime branch|cyber|traffic|women|economic offences|special cell|headquarters|hq|control room|wing|office|police lines?"
# Words that end or rule out a capitalised place phrase.
NOT_PLACES = (
    "police", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "the", "a", "an",
    "delhi", "new", "bengaluru", "bangalore", "goa", "india", "city", "station", "court", "hospital", "january",
    "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "rs", "fir", "ps", "dcp", "acp", "sho", "mr", "mrs", "ms", "dr",
)
STATION_LOCALITY_MAX_KM = 5
EARTH_RADIUS_KM = 6371

# Police enum translations and their defaults.
INCIDENT_PRECISION = {"exact": "exact", "date": "date", "date_range": "date_range", "approx": "date", "unknown": "unknown"}
GEO_PRECISION = {"address": "address", "locality": "locality", "police_station": "police_station", "district": "city", "city": "city"}

MAX_DESCRIPTION = 300
PAGE_DEFAULT, PAGE_MAX = 50, 200
SAMPLE_ROUNDS = 4
