"""Personal information in free text: found, and replaced.

Detection reads each text once: addresses of mail written out or disguised,
telephone numbers, personal identity numbers, street addresses, and names of
people (a given name or initial with a family name, in either order).

Method of replacement: surrogate generation. Every distinct entity gets a
replacement drawn with a keyed hash, so it is the same wherever the entity is
mentioned (coreference) and can't be traced back without the key. A title is no
part of a name; a nickname stands for its full name where only one has it, and a
nickname that several have, or an initial, for the one person of that family
named in full in the same text, if there is one only. A replacement has the kind
and form of what it replaces: people keep gender, script, letter case, initials
and order, numbers keep their punctuation, mail addresses the way they are
disguised. Replacements that fall on one another or on a real entity are drawn
again, from a range that grows with each round, until all are distinct; family
names are, too, so that initials don't confuse two people.

Defined results: positions count Unicode code points; null and empty texts have
no mentions and come back as they are; overlapping finds are settled in the
order mail, street, identity number, telephone, person, longer first; a row
delivered twice counts once; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import checkpointed

from .names_lexicon import CALLED, GIVEN, LEGAL, NICKNAMES, TITLES, TRADES

_AT = r"(?:@|\s?[(\[{<]\s?(?:at|AT|At)\s?[)\]}>]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|DOT|Dot)\s?[)\]}>]\s?|\s(?:dot|DOT)\s)"
EMAIL = re.compile(
    r"(?<![\w.+@-])[\w+-]+(?:\.[\w+-]+)*(?:"
    r"@[\w-]+(?:\.[\w-]+)+"
    r"|\s?[(\[{<]\s?(?:at|AT|At)\s?[)\]}>]\s?[\w-]+(?:" + _DOT + r"[\w-]+)+"
    r"|\s(?:at|AT)\s[\w-]+(?:\s?[(\[{<]?\s?(?:dot|DOT)\s?[)\]}>]?\s?[\w-]+)+)"
)
_EXT = r"(?:,?\s?(?:ext\.?|extension|x|Durchwahl|poste|Ext\.?)\s?\d{1,5})?"
PHONE = re.compile(
    r"(?<![\w/.,:#$€£-])(?<!\d )(?:"
    r"\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,8}){1,4}"
    r"|00\d{1,3}[ .-]\d{2,4}(?:[ .-]\d{2,8}){1,3}"
    r"|\(\d{2,5}\)[ -]?\d{3,4}(?:[ .-]?\d{3,4})?"
    r"|\d{3}([-. ])\d{3}\1\d{4}"
    r"|0\d{1,4}(?:[ /-]\d{2,8}){1,4}"
    r"|[2-9]\d{2}-\d{4}"
    r")" + _EXT + r"(?![\w/]|[-.,]\d| \d{2,}(?![\d,.]*\s))"
)
IDENTITY = [
    re.compile(r"(?<![\w.,/-])[0-9]\d{2}-\d{2}-\d{4}(?![\w/]|-\w|\.\d)"),
    re.compile(r"(?<![\w.,/-])\d{8}-[A-Z](?![\w-])"),
    re.compile(r"(?<![\w.,/-])[A-Z]\d{2}[A-Z]\d{4}[A-Z0-9]{1,2}(?![\w-])"),
    re.compile(r"(?<![\w.,/-])[A-Z]\d{3}-\d{4}-\d{4}(?![\w-])"),
]
_ANNOUNCED = re.compile(
    r"(?:\bSSN|social security(?: (?:number|no\.?))?|pass(?:port|eport|aporte)(?: (?:no\.?|number))?|Reisepass(?:-?Nr\.?)?|(?:national |identity |personal )?(?:ID|id)(?: (?:card|no\.?|number))?"
    r"|identity card(?: no\.?)?|driver[’']?s licen[cs]e(?: no\.?)?|driving licen[cs]e(?: no\.?)?|tax (?:ID|id|number|no\.?)|(?:Personal)?[Aa]usweis-?Nr\.?|Steuer-?(?:ID|Nr\.?)|NI(?:F|E|NO)\b|DNI\b|TIN\b)"
    r"(?:\s?[:#]|\s(?:is|was|number))?\s+"
)
_NUMBER = re.compile(r"[A-Z]{0,3}(?:\d[ -]?[A-Z]?(?=[A-Z\d])|[A-Z](?=\d)| (?=\d)){0,14}\d*(?:\d|(?<=\d)[A-Z]|(?<=\d-)[A-Z])(?![\w])")
_NOT_PERSONAL = re.compile(r"(?:tracking|order|invoice|contract|part|batch|version|case|article|account|customer|item)\s*(?:no\.?|number|id|ID)?\s*[:#]?\s*$", re.I)

_UNIT = r"(?:Flat|FLAT|flat|Apt\.?|APT\.?|Apartment|Suite|SUITE|Unit|UNIT|Floor|Room|Rm\.?|Ste\.?)\s?\d+[A-Za-z]?\b"
_SUFFIX = (
    r"(?:Street|Road|Rd|Lane|Ln|Drive|Dr|Avenue|Boulevard|Blvd|Way|Close|Court|Ct|Terrace|Place|Pl|Crescent|Cres|Square|Sq|Row|Walk|Gardens|Hill|Parkway|Pkwy|Highway|Circle|Quay|Mews"
    r"|STREET|ROAD|RD|LANE|LN|DRIVE|DR|AVENUE|BOULEVARD|BLVD|WAY|CLOSE|COURT|CT|TERRACE|PLACE|PL|CRESCENT|SQUARE|ROW|street|road|lane|drive|avenue|boulevard|way|close|court|terrace|place)\b"
)
STREET = re.compile(
    r"(?<![\w.,/$€£-])(?:" + _UNIT + r",\s)?(?:"
    r"\d{1,5}[A-Za-z]?\s(?:[^\W\d_a-zà-ÿ][\w’'-]*\s){1,3}?(?:" + _SUFFIX + r"|(?:St|ST|Ave|AVE|st|ave)\b\.?)"
    r"|\d{1,5}(?:\s?bis)?,?\s(?i:rue|avenue|place|boulevard|chemin|allée|quai|impasse)\s(?i:de\sla|des|du|de\sl’|de\sl'|de|d’|d'|la|le)?\s?[^\W\d_][\w’'-]*"
    r"|(?i:calle|avenida|plaza|paseo|via|viale|rua)\s(?:(?i:de\sla|del|de|di)\s)?[^\W\d_][\w’'-]*,?\s\d{1,5}\b"
    r"|[^\W\d_]{3,}(?i:weg|straße|strasse|gasse|platz|allee|ufer|damm|laan|straat|gracht)\s\d{1,5}[a-z]?\b"
    r"|[^\W\d_]{3,}(?:str|Str)\.\s?\d{1,5}[a-z]?\b"
    r")(?:,\s" + _UNIT + r"|\s#\s?\d+[A-Za-z]?)?"
)
WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_FAMILY = re.compile(r"[^\W\d_]{2,}(?:[’'-][^\W\d_]+)*")
_MIDDLE = re.compile(r"(?:[ \t]+[^\W\d_]\.)*[ \t]+")
_INITIALS = re.compile(r"(?<![\w.&-])(?<!& )(?:[A-Z]\. ?){1,3}(?=[A-Z])([A-Z][^\W\d_]{2,}(?:[’'-][^\W\d_]+)*)")
_AFTER = re.compile(r"(?<![\w.])([A-Z][^\W\d_]{2,}(?:[’'-][^\W\d_]+)*),[ \t]+(?:[A-Z]\.[ \t]?){1,2}(?!\w)(?![ \t]?[A-Z][^\W\d_]{2,},?[ \t](?:[A-Z]|wrote|said))")
_TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Mme|Herr|Frau|Sr|Sra)\.?[ \t]+([A-Z][^\W\d_]+(?:[ \t]+[A-Z]\.)*[ \t]+[A-Z][^\W\d_]{2,})")
#: Words that can't be a family name (fixed values): words of sentences, streets and filing.
NOT_FAMILY = set(
    "and or the of to in on at by for from with is was has had have will shall may must can wrote said called asked signed presented lives residing went gave about as per via"
    " street road lane drive avenue boulevard way close court terrace place square st rd ave fund trust bay island sons daughters brothers bros dear date total invoice page"
    " this that these those any each either every under upon when where which who if it its he she they we you no not all after before during until yesterday today receives unloaded ssn id tel fax tax phone mobile email".split()
)
#: Given names that are ordinary words when written small.
WORDS_TOO = set("will bill dot pat sue ray rob rich dick hank jack penny bee em art may mark grant rose gene kit chas drew dan ant don bob tom nan rick dolly dora gail lex ned al ed bea bess peg meg jo jon max pip pen kat kay tina tori lu lou ben len hal fran gen win tony terry vic viv".split())


def find_people(text: str) -> Iterator[tuple[int, int]]:
    """Spans of names of people, without titles."""
    taken_to = 0
    for m in WORD.finditer(text):
        word = m.group()
        low = word.lower()
        if low not in GIVEN or m.start() < taken_to:
            continue
        if word == low and (low in WORDS_TOO or low not in NICKNAMES):
            continue
        after = _MIDDLE.match(text, m.end())
        family = _FAMILY.match(text, after.end()) if after else None
        if family and _is_family(word, family.group()) and not _company(text, family.end()):
            yield m.start(), family.end()
            taken_to = family.end()
            continue
        span = _reversed(text, m)
        if span and span[0] >= taken_to:
            yield span
            taken_to = span[1]
    for m in _INITIALS.finditer(text):
        if m.group(1).lower() not in NOT_FAMILY and m.group(1).lower() not in LEGAL and m.group(1).lower() not in GIVEN and not _company(text, m.end()):
            yield m.span()
    for m in _AFTER.finditer(text):
        if m.group(1).lower() not in NOT_FAMILY and m.group(1).lower() not in LEGAL | TRADES | TITLES:
            end = m.end()
            while text[end - 1].isspace():
                end -= 1
            yield m.start(), end
    for m in _TITLED.finditer(text):
        if m.group(1).split()[-1].lower() not in NOT_FAMILY and m.group(1).split()[0].lower() not in TITLES and not _company(text, m.end()):
            yield m.span(1)


def _is_family(given: str, family: str) -> bool:
    low = family.lower()
    if low in NOT_FAMILY or low in LEGAL or low in TRADES:
        return False
    if family.isupper() != given.isupper():
        return False
    if given.islower():
        return family.islower() and len(family) >= 4
    return family[0].isupper()


def _company(text: str, at: int) -> bool:
    """Do words of a company's name follow?"""
    for _ in range(3):
        m = re.compile(r"[ \t]*&?[ \t]+([^\W\d_][\w.]*)").match(text, at)
        if not m or not m.group(1)[0].isupper():
            return False
        low = m.group(1).replace(".", "").lower()
        if low in TRADES or low in LEGAL:
            return True
        at = m.end()
    return False


_BEFORE = re.compile(r"([^\W\d_]{3,}(?:[’'-][^\W\d_]+)*),[ \t]+$")
_TAIL = re.compile(r"(?:[ \t]+[^\W\d_]\.)*")


def _reversed(text: str, given: re.Match) -> tuple[int, int] | None:
    """Span of ``Family, Given`` around a given name."""
    before = _BEFORE.search(text, max(0, given.start() - 60), given.start())
    if not before:
        return None
    family, word = before.group(1), given.group()
    if family.lower() in GIVEN or not _is_family(word, family) or family.lower() in TITLES:
        return None
    if word.islower() and len(family) < 6:
        return None
    if before.start() and (text[before.start() - 1].isalnum() or text[before.start() - 1] in "&-"):
        return None
    if re.search(r"(?:&|\band)[ \t]+$", text[max(0, before.start() - 6) : before.start()]):
        return None
    return before.start(), _TAIL.match(text, given.end()).end()


def mentions(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal information of a text, in order and without overlaps."""
    if not text:
        return []
    found: list[tuple[int, int, int, str]] = []
    if "@" in text or "at" in text.lower():
        found += [(0, *m.span(), "email") for m in EMAIL.finditer(text) if _has_top(m.group())]
    found += [(1, *m.span(), "street_address") for m in STREET.finditer(text)]
    for pattern in IDENTITY:
        found += [(2, *m.span(), "id_number") for m in pattern.finditer(text) if not _NOT_PERSONAL.search(text, max(0, m.start() - 30), m.start())]
    for a in _ANNOUNCED.finditer(text):
        m = _NUMBER.match(text, a.end())
        if m and sum(c.isdigit() for c in m.group()) >= 6 and not re.search(r"(?i)tracking\s*$", text[max(0, a.start() - 12) : a.start()]):
            found.append((2, *m.span(), "id_number"))
    found += [(3, *m.span(), "phone") for m in PHONE.finditer(text) if _is_phone(text, m)]
    found += [(4, *span, "person") for span in find_people(text)]
    found.sort(key=lambda f: (f[0], f[1] - f[2], f[1]))
    taken: list[tuple[int, int, str]] = []
    for _, a, b, kind in found:
        if all(b <= x or y <= a for x, y, _ in taken):
            taken.append((a, b, kind))
    taken.sort()
    return taken


def _has_top(address: str) -> bool:
    return bool(re.search(r"[^\W\d_]{2,}$", address))


_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$|\d{4}-\d{2}-\d{2}$")


def _is_phone(text: str, m: re.Match) -> bool:
    value = m.group()
    digits = sum(c.isdigit() for c in value)
    if _DATE.match(value) or digits < 7 or digits > 20:
        return False
    return not _NOT_PERSONAL.search(text, max(0, m.start() - 30), m.start()) and not re.search(r"(?:\bPO|\bINV|\bRef\.|\bWO|\b1Z)[ -]?(?:\d+ )*$", text[max(0, m.start() - 16) : m.start()])


# --- replacement


#: Made-up given names by gender, and parts of family names (fixed values).
FEMALE = "Adela Brenna Corisande Delphine Elspeth Fiorella Ginevra Hedwig Ilse Jocasta Kerensa Linnea Mirabel Ottilie Perpetua Rosalba Sidonie Tamsin Una Verity Wilhelmina Xanthe Ysolde Zinnia".split()
MALE = "Ambrose Barnaby Cuthbert Desmond Ephraim Fergus Gideon Horatio Ignatius Jasper Kenelm Lionel Montague Neville Osbert Peregrine Quentin Roderick Septimus Thaddeus Urban Valentine Wystan Yorick".split()
FEMALE_GIVEN = set(
    "abigail alexandra anne barbara beatrice catherine christine cynthia deborah dorothy eleanor elizabeth emily frances gabriela harriet imogen isabella janet jennifer josephine katherine"
    " lucille margaret martha mildred nora patricia penelope rebecca sarah susan theresa ursula victoria winifred yolanda".split()
)
PARTS = "ald brim cress dunn esk farr glen hart ivel jarr keld lorn marl nash orm penn quill rook stow thorn ulv wend yarr zell".split()
ENDS = "bank brook cote dale field ford gate ham land ley mere ridge shaw ton wick wood".split()
STREETS = "Amberley Bracken Chantry Dovecote Elderberry Fennel Gorse Heron Inglenook Jasmine Kestrel Linnet Meadow Nightjar Osprey Primrose Quince Rowan Sorrel Teasel Umber Vetch Willow Yarrow".split()


#: Rounds in which numbers stay in the format of their entity; one that is still taken then gets further digits.
FORMAT_ROUNDS = 12
#: Mentions of an entity that one part of a join holds.
PART = 50_000


def draw(key: bytes, *parts: object) -> int:
    """A large number that depends on the key and all parts."""
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha512).digest(), "big")


def identity(kind: str, value: str) -> str:
    """What all mentions of one entity have in common."""
    low = " ".join(value.lower().split())
    if kind == "email":
        low = re.sub(r"\s?[(\[{<]\s?at\s?[)\]}>]\s?|\sat\s", "@", low)
        return re.sub(r"\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s", ".", low)
    if kind in ("phone", "id_number"):
        return re.sub(r"[^a-z0-9]", "", low)
    if kind == "person":
        first, family = (x.lower() for x in person_parts(value))
        full = CALLED.get(first, {first})
        return f"{next(iter(full)) if len(full) == 1 else first} {family}"
    return low


def entities(text: str, spans: list[tuple[int, int, str]]) -> list[str]:
    """The entity of each mention of a text; names given in part are those of the one person whom they fit there."""
    found = [identity(kind, text[a:b]) for a, b, kind in spans]
    named = [tuple(x.lower() for x in person_parts(text[a:b])) if kind == "person" else ("", "") for a, b, kind in spans]
    people: dict[str, set[tuple[str, str]]] = {}
    for entity, (given, family) in zip(found, named):
        if len(given) > 1:
            people.setdefault(family, set()).add((given, entity))
    for k, (given, family) in enumerate(named):
        if len(given) == 1:
            fits = {e for g, e in people.get(family, ()) if g[0] == given}
        elif len(CALLED.get(given, ())) > 1:
            fits = {e for g, e in people.get(family, ()) if g in CALLED[given] and g != given}
        else:
            continue
        if len(fits) == 1:
            found[k] = fits.pop()
    return found


_TITLE = re.compile(r"^(?:(?:" + "|".join(sorted(TITLES - {"m"})) + r")\b\.?\s+)+(?=\S+\s)", re.I)


def person_parts(value: str) -> tuple[str, str]:
    """(given name or initial, family name) of a mention, without titles."""
    value = _TITLE.sub("", value.strip())
    if "," in value:
        family, _, rest = value.partition(",")
        return rest.split()[0].strip("."), family.strip()
    words = value.split()
    return words[0].split(".")[0], words[-1].split(".")[-1] or words[-1]


def replacement(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The identity of the surrogate of an entity; forms are given to it per mention."""
    n = draw(key, kind, entity, attempt)
    if kind == "person":
        given = entity.split(" ", 1)[0]
        names = [x for x in FEMALE + MALE if x[0].lower() == given] if len(given) == 1 else []
        full = CALLED.get(given, {given})
        if full <= FEMALE_GIVEN:
            names = FEMALE
        elif full <= set(NICKNAMES) - FEMALE_GIVEN:
            names = MALE
        n, g = divmod(n, 1 << 16)
        names = names or FEMALE + MALE
        parts = []
        for _ in range(4 + attempt):
            n, k = divmod(n, len(PARTS))
            parts.append(PARTS[k])
        return f"{names[g % len(names)]} {''.join(parts).capitalize()}{ENDS[n % len(ENDS)]}"
    if kind == "email":
        n, a = divmod(n, len(PARTS))
        n, b = divmod(n, len(ENDS))
        digits = 10 + attempt
        return f"{PARTS[a]}.{n % 10**digits:0{digits}d}@{ENDS[b]}.invalid"
    if kind == "street_address":
        n, a = divmod(n, len(STREETS))
        n, house = divmod(n, 9000)
        parts = []
        for _ in range(2 + attempt):
            n, k = divmod(n, len(PARTS))
            parts.append(PARTS[k])
        return f"{house + 1000} {''.join(parts).capitalize()}{STREETS[a].lower()}"
    out, led = [], False
    for c in entity + "9" * max(0, attempt - FORMAT_ROUNDS):
        # leading zeros and a first digit that isn't low keep a number of the same type readable as one
        n, d = divmod(n, (10 if led else 8) if c.isdigit() else 26)
        out.append("0" if c == "0" and not led else str(d if led else d + 2) if c.isdigit() else chr(97 + d))
        led = led or c in "123456789"
    return "".join(out)


def in_form(kind: str, value: str, surrogate: str) -> str:
    """The surrogate in the form of a mention: its case, order, punctuation and disguise."""
    if kind == "person":
        given, family = surrogate.split(" ", 1)
        first, own = person_parts(value)
        new = given[0] if len(first) == 1 else given
        if first.isupper() and len(first) > 1 or own.isupper():
            new, family = new.upper(), family.upper()
        elif first.islower():
            new, family = new.lower(), family.lower()
        if any(ord(c) > 0x24F for c in own if c.isalpha()):
            return _in_script(own, value.replace(own, family).replace(first, new))
        return re.sub(rf"(?<!\w){re.escape(first)}(?!\w)", new, re.sub(rf"{re.escape(own)}(?!\w)", family, value, count=1), count=1)
    if kind == "email":
        user, _, host = surrogate.partition("@")
        at = re.search(_AT, value)
        dots = re.findall(r"\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s", value[at.end() :], re.I) if at else []
        made = user + (at.group() if at else "@") + host.replace(".", dots[0] if dots else ".")
        return made.upper() if value.isupper() else made
    if kind == "street_address":
        number, name = surrogate.split(" ", 1)
        kept = set("flat apt apartment suite unit floor room rue calle avenida plaza avenue place boulevard via des de la du del le".split())
        units = {"flat", "apt", "apartment", "suite", "unit", "floor", "room", "rm", "ste"}
        out, named, numbered = [], False, False
        for token in re.split(r"(\s+|,)", value):
            low = token.lower().strip(".#")
            if token.isdigit() or (token[:1].isdigit() and low[:-1].isdigit()):
                unit = bool(out[-2:-1]) and out[-2].lower().strip(".") in units
                out.append(str(int(number[::-1]) % 90 + 1) if unit or numbered else number)
                numbered = numbered or not unit
            elif token.startswith("#"):
                out.append("#" + str(int(number[::-1]) % 90 + 1))
            elif token[:1].isalpha() and low not in kept and not re.fullmatch(_SUFFIX + r"|(?:St|ST|Ave|AVE|st|ave)\.?", token):
                m = re.fullmatch(r"(.+?)(weg|straße|strasse|gasse|platz|allee|ufer|damm|laan|straat|gracht|str\.)", token, re.I)
                new = name + (m.group(2).lower() if m else "")
                if named:
                    continue
                out.append(new.upper() if token.isupper() and len(token) > 1 else new)
                named = True
            else:
                out.append(token)
        return re.sub(r"(\s)\s+", r"\1", "".join(out))
    letters = iter(surrogate)
    made = "".join((next(letters, "0").upper() if c.isupper() else next(letters, "0")) if c.isascii() and c.isalnum() else c for c in value)
    return made + "".join(letters)


def _in_script(like: str, text: str) -> str:
    """Latin letters carried over to the script of a name (Greek or Cyrillic)."""
    cyrillic = dict(zip("abcdefghijklmnopqrstuvwxyz", "абцдефгхижклмнопкрстуввхыз"))
    greek = dict(zip("abcdefghijklmnopqrstuvwxyz", "αβκδεφγχιικλμνοπκρστυβωξυζ"))
    table = cyrillic if any("Ѐ" <= c <= "ӿ" for c in like) else greek if any("Ͱ" <= c <= "Ͽ" for c in like) else {}
    return "".join(table[c.lower()].upper() if c.isupper() and c.lower() in table else table.get(c, c) for c in text)


_MENTION = "k string, start_pos int, end_pos int, pii_kind string, mention string, entity string"


def find_mentions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, start_pos, end_pos, pii_kind, mention, entity: one row per mention in each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = mentions(text)
                rows += [(k, a, b, kind, text[a:b], entity) for (a, b, kind), entity in zip(spans, entities(text, spans))]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["k", "start_pos", "end_pos", "pii_kind", "mention", "entity"])

    source = df.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    return source.mapInArrow(run, _MENTION).withColumn("k", F.col("k").cast(dict(df.dtypes)[id_col])).withColumnRenamed("k", id_col)


def surrogates(entities: DataFrame, key: bytes, rounds: int | None = None) -> DataFrame:
    """pii_kind, entity, surrogate: distinct replacements for all distinct entities, none of them a real one.

    Only replacements that clash are drawn again, each time from a wider range, so it ends however many entities there are.
    """
    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names, tries = (c.to_pylist() for c in batch.columns)
            made = [replacement(key, *row) for row in zip(kinds, names, tries)]
            whole = [identity(k, m) for k, m in zip(kinds, made)]
            told = [m.split(" ", 1)[-1] if k == "person" else w for k, m, w in zip(kinds, made, whole)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(x, pa.string()) for x in (made, whole, told))], names=["pii_kind", "entity", "attempt", "surrogate", "as_entity", "told_by"])

    schema = "pii_kind string, entity string, attempt int, surrogate string, as_entity string, told_by string"
    pending = checkpointed(entities.select("pii_kind", "entity").distinct().withColumn("attempt", F.lit(0)).mapInArrow(drawn, schema))
    n = 0
    while True:
        n += 1
        real = pending.select("pii_kind", F.col("entity").alias("as_entity"), F.lit(True).alias("real"))
        # one that stood before keeps its place against those drawn later
        first = pending.groupBy("pii_kind", "told_by").agg(F.min(F.struct("attempt", "entity")).alias("keeps"))
        judged = pending.join(first, ["pii_kind", "told_by"]).join(real, ["pii_kind", "as_entity"], "left")
        judged = checkpointed(judged.select("pii_kind", "entity", "attempt", "surrogate", "as_entity", "told_by", (F.col("real").isNotNull() | (F.col("entity") != F.col("keeps.entity"))).alias("bad")))
        if not judged.where("bad").limit(1).count():
            return judged.select("pii_kind", "entity", "surrogate")
        if rounds and n >= rounds:
            raise RuntimeError("replacements didn't become distinct")
        again = judged.where("bad").select("pii_kind", "entity", (F.col("attempt") + 1).cast("int").alias("attempt")).mapInArrow(drawn, schema)
        pending = checkpointed(judged.where("NOT bad").drop("bad").unionByName(again))


def with_surrogates(found: DataFrame, made: DataFrame) -> DataFrame:
    """Mentions with the surrogates of their entities; an entity of many mentions is met in parts."""
    keys = ["pii_kind", "entity"]
    sizes = found.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    hot = F.broadcast(sizes.where("parts > 1"))  # at most one entity in PART mentions
    asked = found.join(hot, keys, "left").withColumn("part", F.pmod(F.xxhash64("start_pos", "mention", F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    answers = made.join(hot, keys, "left").select(*keys, "surrogate", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return asked.join(answers, [*keys, "part"]).drop("part")


def replaced(df: DataFrame, id_col: str, text_col: str, key: bytes) -> DataFrame:
    """id, ``placeholders`` and ``surrogates``: each text with its mentions replaced both ways.

    Placeholders name the kind and, by a keyed number, the entity; surrogates read like the original.
    """
    texts = df.select(id_col, text_col).dropDuplicates([id_col])
    found = checkpointed(find_mentions(texts, id_col, text_col))
    made = with_surrogates(found, surrogates(found, key)).groupBy(id_col).agg(
        F.collect_list(F.struct("start_pos", "end_pos", "pii_kind", "mention", "entity", "surrogate")).alias("found")
    )
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked, spoken = [], []
            for text, finds in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not finds:
                    marked.append(text)
                    spoken.append(text)
                    continue
                at, a, b = 0, [], []
                for f in sorted(finds, key=lambda f: f["start_pos"]):
                    before = text[at : f["start_pos"]]
                    a += [before, f"[{f['pii_kind'].upper()}-{draw(key, 'tag', f['pii_kind'], f['entity']) % 16**32:032x}]"]
                    b += [before, in_form(f["pii_kind"], f["mention"], f["surrogate"])]
                    at = f["end_pos"]
                marked.append("".join(a) + text[at:])
                spoken.append("".join(b) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marked, pa.string()), pa.array(spoken, pa.string())], names=[id_col, "placeholders", "surrogates"])

    return texts.join(made, id_col, "left").select(id_col, text_col, "found").mapInArrow(run, f"`{id_col}` {kind}, placeholders string, surrogates string")
