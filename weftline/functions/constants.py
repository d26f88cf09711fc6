"""Word lists, code tables and markers that results depend on."""

# Words dropped from a name by the first cleaner.
DROP_TOKENS = [
    "private", "pvt", "limited", "ltd", "llp", "public", "opc",
    "llc", "inc", "incorporated", "corp", "corporation", "co", "company", "pc", "pllc", "lp", "plc",
    "sarl", "sas", "sasu", "sa", "eurl", "snc", "sci",
    "ms", "dr", "the", "and", "et", "com", "www",
]

# Legal forms, fillers and generic words of the second cleaner.
LEGAL = [
    "private", "pvt", "limited", "ltd", "llp", "opc", "public",
    "llc", "inc", "incorporated", "corp", "corporation", "co", "company", "pc", "pllc", "lp", "plc", "lc",
    "sarl", "sas", "sasu", "sa", "eurl", "snc", "sci", "ei", "selarl", "scp", "scop",
]
FILLER = ["ms", "dr", "mr", "mrs", "messrs", "the", "and", "et", "und"]
GENERIC = [
    "center", "centre", "services", "service", "partners", "group", "groupe", "holding", "holdings", "international",
    "developpement", "development", "distribution", "participations",
]

# Markers between two names: the text after, or before, is the name.
AFTER_MARKERS = ["formerly known as", "formerly", "fka", "f/k/a"]
BEFORE_MARKERS = ["dba", "d/b/a", "aka", "a/k/a", "t/a"]

# Digits written for letters.
DIGITS, LETTERS = "013458", "oleasb"

# Names of states and regions, and their codes.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "district of columbia": "dc", "florida": "fl", "georgia": "ga", "hawaii": "hi",
    "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la",
    "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj",
    "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd",
    "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "puerto rico": "pr",
}
INDIAN_STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "chattisgarh": "cg",
    "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl",
    "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl",
    "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "tamilnadu": "tn",
    "telangana": "ts", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk", "uttaranchal": "uk", "west bengal": "wb",
    "delhi": "dl", "new delhi": "dl", "jammu and kashmir": "jk", "jammu kashmir": "jk", "puducherry": "py", "pondicherry": "py",
    "chandigarh": "ch", "ladakh": "la", "andaman and nicobar islands": "an", "lakshadweep": "ld",
    "dadra and nagar haveli": "dn", "daman and diu": "dd",
}
INDIAN_ALIASES = {"or": "od", "ct": "cg", "tg": "ts", "ut": "uk", "del": "dl"}
FRENCH_REGIONS = {
    "hauts de france": "hdf", "nord": "hdf", "pas de calais": "hdf", "nouvelle aquitaine": "naq", "gironde": "naq",
    "pays de la loire": "pdl", "loire atlantique": "pdl",
}

# Abbreviations in addresses.
US_ABBREVIATIONS = {
    "st": "street", "str": "street", "rd": "road", "dr": "drive", "drv": "drive", "ave": "avenue", "av": "avenue",
    "avn": "avenue", "ln": "lane", "ct": "court", "crt": "court", "blvd": "boulevard", "hwy": "highway", "pkwy": "parkway",
    "cir": "circle", "pl": "place", "ter": "terrace", "trl": "trail", "sq": "square", "mt": "mount", "ft": "fort",
    "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast",
    "sw": "southwest", "hts": "heights", "twp": "township", "cty": "county", "expy": "expressway", "fwy": "freeway",
    "jct": "junction", "rte": "route",
}
INDIAN_ABBREVIATIONS = {
    "rd": "road", "st": "street", "ngr": "nagar", "opp": "opposite", "nr": "near", "bldg": "building", "flr": "floor",
    "apt": "apartment", "mkt": "market", "sec": "sector", "sect": "sector", "extn": "extension", "ext": "extension",
    "clny": "colony", "chwk": "chowk",
}
FRENCH_ABBREVIATIONS = {
    "r": "rue", "av": "avenue", "ave": "avenue", "bd": "boulevard", "blvd": "boulevard", "bld": "boulevard", "all": "allee",
    "imp": "impasse", "pl": "place", "rte": "route", "ch": "chemin", "chem": "chemin", "st": "saint", "ste": "sainte",
    "fbg": "faubourg", "sq": "square", "crs": "cours", "qu": "quai", "res": "residence", "lot": "lotissement",
}

# Words of addresses that tell nothing.
COMMON_STOP = ["na", "null", "none", "unknown", "address", "and", "of", "the"]
US_STOP = [
    "unit", "suite", "ste", "apartment", "apt", "floor", "fl", "building", "bldg", "usa", "us", "box", "po", "pmb", "number",
    "no", "rm", "room",
]
INDIAN_STOP = [
    "no", "near", "opposite", "floor", "flat", "plot", "door", "house", "shop", "office", "block", "sector", "at", "po", "ps",
    "dist", "district", "city", "india", "ground", "first", "second", "third", "unit", "room", "c", "o", "h", "tal", "taluk",
    "tehsil", "via", "post", "building", "apartment",
]
FRENCH_STOP = ["de", "la", "le", "les", "du", "des", "d", "l", "et", "bis", "ter", "france", "cedex", "n", "no", "au", "aux", "en"]
