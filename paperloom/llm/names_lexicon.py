"""Fixed values of the name operators: legal forms, trades and their short forms, regions, titles, given names."""

#: Legal forms as they stand once dots inside a word are dropped.
LEGAL = set("inc incorporated corp corporation co company llc ltd limited plc gmbh bv sa lp llp nv ag sarl srl pte pty ab oy as kg".split())

#: Trades by their short forms.
TRADES_SHORT = {
    "analyt": "analytics", "arch": "architects", "archs": "architects", "assoc": "associates", "assocs": "associates", "avn": "aviation",
    "aviat": "aviation", "brok": "brokerage", "brkg": "brokerage", "ceram": "ceramics", "comm": "communications", "comms": "communications",
    "commun": "communications", "constr": "construction", "const": "construction", "cons": "consulting", "consult": "consulting",
    "dev": "development", "devel": "development", "dist": "distribution", "distr": "distribution", "distrib": "distribution", "elec": "electric",
    "electr": "electric", "eng": "engineering", "engrg": "engineering", "engr": "engineering", "engg": "engineering", "equip": "equipment",
    "eqpt": "equipment", "fdry": "foundry", "fin": "financial", "financ": "financial", "frt": "freight", "hdwe": "hardware", "hdw": "hardware",
    "hdwr": "hardware", "hldg": "holdings", "hldgs": "holdings", "ind": "industries", "inds": "industries", "indus": "industries", "ins": "insurance",
    "insur": "insurance", "instr": "instruments", "instrs": "instruments", "lab": "laboratories", "labs": "laboratories", "log": "logistics",
    "logist": "logistics", "mfg": "manufacturing", "manuf": "manufacturing", "mgmt": "management", "mgt": "management", "mar": "maritime",
    "marit": "maritime", "mill": "milling", "nurs": "nurseries", "opt": "optics", "orch": "orchards", "outf": "outfitters", "pack": "packaging",
    "pkg": "packaging", "pkgg": "packaging", "pharm": "pharmaceuticals", "pharma": "pharmaceuticals", "prop": "properties", "props": "properties",
    "pub": "publishing", "publ": "publishing", "refrig": "refrigeration", "serv": "services", "servs": "services", "svc": "services",
    "svcs": "services", "ship": "shipping", "shpg": "shipping", "surv": "surveying", "tech": "technologies", "techn": "technologies",
    "technol": "technologies", "techs": "technologies", "text": "textiles", "tex": "textiles", "trans": "transport", "transp": "transport",
    "vent": "ventures", "vents": "ventures",
}
TRADES = set(TRADES_SHORT.values()) | {"dairies", "trading", "capital", "energy", "foods", "media", "partners", "systems", "solutions", "bank", "group"}

REGIONS = set("north south east west europe overseas international america americas asia africa pacific central northern southern eastern western global".split())
NUMERALS = {"ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "2": "2", "3": "3", "4": "4", "5": "5"}
TITLES = set("mr mrs ms miss dr prof sir madam mme m herr frau sr sra mx rev hon".split())

#: Nicknames: the given name on the left is also called by those on the right.
NICKNAMES = {
    "abigail": "abby abbie gail", "alexander": "alex al sandy xander lex", "alexandra": "alex sandra sandy", "andrew": "andy drew", "anne": "annie nan ann",
    "anthony": "tony ant", "barbara": "barb babs barbie", "beatrice": "bea trixie bee", "benjamin": "ben benny benji", "catherine": "cathy kate cat",
    "charles": "charlie chuck chas", "christine": "chris tina chrissy", "christopher": "chris kit", "cynthia": "cindy cyndi", "daniel": "dan danny",
    "david": "dave davy", "deborah": "deb debbie debby", "donald": "don donny", "dorothy": "dot dottie dolly dora", "douglas": "doug dougie",
    "edward": "ed eddie ted ned teddy", "eleanor": "nell ellie nora nellie", "elizabeth": "liz beth betty lizzie eliza bess libby", "emily": "em emmy", "frances": "fran fanny",
    "francis": "frank fran", "frederick": "fred freddie freddy rick", "gabriela": "gabby gaby gabi ella", "george": "georgie", "gerald": "gerry jerry", "gregory": "greg gregg",
    "harriet": "hattie harri etta", "harold": "harry hal", "henry": "hank harry hal", "imogen": "immy gen immie", "isabella": "bella izzy isa belle", "james": "jim jimmy jamie",
    "janet": "jan", "jennifer": "jen jenny", "john": "jack johnny jon", "jonathan": "jon jonny", "joseph": "joe joey", "josephine": "jo josie posy",
    "katherine": "kate kathy katie kat kay kitty", "kenneth": "ken kenny", "lawrence": "larry laurie lawrie", "leonard": "len lenny leo", "lucille": "lucy lou lu", "margaret": "maggie peg peggy meg marge greta rita",
    "martha": "marty", "matthew": "matt", "michael": "mike mick mickey", "mildred": "millie milly", "nathaniel": "nate nat nathan", "nicholas": "nick nicky", "nora": "norah",
    "oliver": "ollie olly noll", "patricia": "pat patty trish tricia patsy", "patrick": "pat paddy", "penelope": "penny pen nell", "peter": "pete", "philip": "phil pip",
    "raymond": "ray", "rebecca": "becky becca reba", "richard": "dick rick rich ricky", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie", "samuel": "sam sammy",
    "sarah": "sally sadie", "stephen": "steve steph stevie", "susan": "sue susie suzy", "theodore": "ted theo teddy", "theresa": "tess terry tessa tracy", "thomas": "tom tommy",
    "timothy": "tim timmy", "ursula": "ursie uschi", "victoria": "vicky tori vicki vic", "vincent": "vince vinny", "walter": "walt wally", "wilfred": "wilf will", "william": "bill will billy liam willy",
    "winifred": "winnie freddie win", "yolanda": "yoli yola lana", "zachary": "zach zack zak",
}
CALLED: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _n in (_full, *_short.split()):
        CALLED.setdefault(_n, set()).add(_full)
GIVEN = set(CALLED)
