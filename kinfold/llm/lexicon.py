"""Fixed values of the name and address rules: abbreviations, nicknames, legal forms, street kinds, regions."""

#: Fixed values. Word of a name -> abbreviations of it.
ABBREVIATIONS = {
    "associates": "assoc assocs", "centre": "ctr center", "construction": "constr const", "consulting": "cons consltg", "contractors": "contr contrs", "distributors": "dist distrib", "electrical": "elec electl",
    "engineering": "eng engg", "enterprises": "ent entp", "furniture": "furn", "garden": "gdn", "group": "grp", "hospital": "hosp hospl", "industries": "ind inds", "international": "int intl", "jewellers": "jewelers jwlrs",
    "logistics": "logist lgstcs", "management": "mgmt mgt", "manufacturing": "mfg manuf", "medical": "med medl", "packaging": "pkg packg", "pharmacy": "pharm phcy", "photography": "photo", "restaurant": "rest restrnt",
    "services": "svc svcs serv", "stores": "strs", "supplies": "supp suppl", "systems": "sys", "technologies": "tech techs technlgs", "textiles": "tex txtls", "veterinary": "vet", "works": "wks",
    "brothers": "bros", "daughters": "dtrs", "sons": "son sos sns", "global": "gl glbl", "royal": "roy ryl", "metro": "met mtro", "nordic": "nord nrdc",
    "house": "hse", "express": "exp xpress", "station": "stn stat", "mobile": "mob", "club": "clb", "bank": "bnk", "mother": "mthr", "hotels": "htls", "coffee": "cofee", "kitchen": "kitchn", "store": "stor", "farm": "farms",
    "shoes": "shoe footwear", "sweets": "sweet",
}

#: Fixed values. First words of a line of business; the second word of a line adds nothing to its identity.
LINES = """auto bakery book brewery catering chemicals construction consulting cycle dental distributors electrical engineering enterprises flooring foods furniture garden hardware hospital jewellers landscaping
laundry logistics management manufacturing medical motors opticians packaging pharmacy photography plumbing printing restaurant roofing security steel tailors technologies textiles trading travel veterinary""".split()
SECONDS = "agency associates care centre clinic company contractors corporation group house industries international mart press repair services stores studio supplies systems works".split()
KIN = "brothers daughters sons".split()
BRANDS = "global metro nordic royal".split()
LEGAL = "ag co company corp corporation corpn gmbh inc incorporated kg limited limted llc llp lnc ltd mbh plc private pte pvt".split()

#: Fixed values. Given name -> short and pet forms.
NICKNAMES = {
    "alexander": "alex sasha sandy xander", "balakrishna": "balu bala", "dorothy": "dot dolly dottie", "edward": "ed ned ted eddie", "elizabeth": "liz beth betty eliza", "friedrich": "fritz fred", "heinrich": "heinz", "johannes": "hans jo",
    "katherine": "kate kathy kat", "krishnan": "krish kannan", "lakshmi": "laxmi lachmi", "margaret": "maggie peggy meg", "rajesh": "raju raj", "richard": "dick rick rich", "robert": "bob bobby rob bert",
    "susannah": "sue susie susan", "theodore": "theo ted teddy", "venkatesh": "venky", "wilhelmina": "mina minna willa", "william": "bill will billy",
}

#: Fixed values. Kind of street -> spellings of it.
STREETS = {
    "allee": "alle al", "avenue": "ave av aven", "boulevard": "blvd boul bvd", "colony": "col clny", "court": "ct crt", "crescent": "cres crsc", "cross": "crs x", "drive": "dr drv", "gasse": "gss g", "lane": "ln la", "layout": "lyt",
    "link": "lk", "marg": "mg mrg", "nagar": "ngr nagr", "parkway": "pkwy pky", "platz": "pltz pl", "road": "rd", "strasse": "straße", "street": "st str strt", "terrace": "ter terr", "weg": "wg",
}
REGIONS = {
    "nc": "north corra", "wh": "west halden", "lp": "lower pell", "ts": "tessaly", "mv": "marrow valley", "os": "ostrania", "bn": "barkhand nadu", "vp": "vandhara pradesh", "ko": "koshana", "tm": "tirumandal",
    "nm": "niedermark", "oh": "ostheim", "ow": "oberwalden", "eq": "east quay", "wp": "west point", "c": "central",
}
TOWN_ENDS = ("burg", "field", "ton", "ville", "abad", "kot", "nagari", "pur", "bruck", "dorf", "hausen", "stadt")
TOWN_SECONDS = ("heights", "point", "quay", "springs")
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
#: Fixed values. Texts that stand for a missing name.
PLACEHOLDERS = {"", "n a", "na", "null", "none", "unknown", "xxx", "test", "test record", "not available", "nil", "tbd", "tba", "no name", "not known", "x"}
