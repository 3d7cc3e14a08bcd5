"""Personal data with DataFrame functions only: patterns, checksums and context words.

Each kind has a pattern that proposes spans and a check that confirms them: length of digits,
Luhn, mod-97 or the range of address parts. Spans of the base kinds stand by themselves. The
added kinds (iban, ssn, local) need a score: a start value by kind, more for a passed checksum
and for context words within ``WINDOW`` characters before, less for words that speak against.

A null text is empty and has no spans. Offsets are code points, end exclusive. Patterns are
written so that no text makes them step back or recurse, however long its runs of digits.
Repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.llm.tables import table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local")
# Fixed patterns. A match can start only where a run starts or the last match ended, and runs
# are taken whole: the same matches as without, found in one pass.
_LOCAL = "[A-Za-z0-9._%+-]"
# Characters of an account number by country (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# A number ends where its country says, whatever word follows; of other countries the run is taken whole.
_IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items())
_IBAN_ELSE = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN}|{_IBAN_ELSE})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9+.-])\(?0[0-9]{2,4}\)?[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9-])",
}
#: What a text must have for a pattern to match at all; most texts have none of it.
NEEDS = {"email": "@", "phone": "+"}
DIGITS = {"card": (16, 19), "phone": (8, 15)}
WINDOW, LEAST_SCORE = 40, 0.5
#: Matches whose places are added up at a time.
BLOCK = 256
START = {"iban": 0.6, "ssn": 0.35, "local": 0.3}
# Words near a span that speak for its kind, and against any.
CONTEXT = {
    "iban": r"(?i)\b(iban|konto|account|compte|cuenta|bank)",
    "ssn": r"(?i)\b(ssn|social security|sozialversicherung|sécurité sociale|seguridad social)",
    "local": r"(?i)\b(tel|phone|call|fax|mobile|telefon|anruf|handy|téléphone|portable|teléfono|móvil)",
}
AGAINST = r"(?i)\b(isbn|issn|doi|order|version|example|serial|nr|part)\b"
FOR, LESS = 0.3, 0.25


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, F.lit("[^0-9]"), F.lit(""))


def mod97(c: Column) -> Column:
    """Whether an account number passes the mod-97 check of ISO 13616."""
    plain = F.regexp_replace(c, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    values = F.filter(F.split(turned, ""), lambda x: x != "")

    def step(rest: Column, x: Column) -> Column:
        v = F.when(x.between("0", "9"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
        return ((rest * F.when(v < 10, 10).otherwise(100) + v) % 97).cast("int")

    return F.aggregate(values, F.lit(0), step) == 1


def _valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # Leading zeros count as written: a part is a number of any length up to 255.
        part = lambda x: F.regexp_replace(x, F.lit("^0+(?=[0-9])"), F.lit(""))
        return F.forall(F.split(found, r"\."), lambda x: (F.length(part(x)) <= 3) & (part(x).try_cast("int") <= 255))
    if kind in DIGITS:
        low, high = DIGITS[kind]
        sized = F.length(_digits(found)).between(low, high)
        return F.when(sized, F.call_function("luhn_check", _digits(found))).otherwise(F.lit(False)) if kind == "card" else sized
    if kind == "ssn":
        return ~found.rlike(r"^(000|666|9)|-00-|-0000$")
    return F.lit(True)


_SPANS = "array<struct<start:long,end:long,found:string>>"


def _matches(kind: str) -> Column:
    """Array of (piece, found): a kind's matches, each with the text between it and the one before."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    return F.zip_with(F.slice(F.split("t", pattern, -1), 1, F.size(found)), found, lambda p, f: F.struct(p.alias("piece"), f.alias("found")))


def _spans(matches: str) -> Column:
    """Array of (start, end, found) of a column of matches.

    Lengths are added up within blocks and then over blocks, since an array that grows by one entry at a time is copied
    for each of them.
    """
    zero, none = F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.length(x["found"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], one).alias("spans"))

    def joined(acc: Column, x: Column) -> Column:
        moved = F.transform(x["spans"], lambda s: F.struct((acc["at"] + s["start"]).alias("start"), (acc["at"] + s["end"]).alias("end"), s["found"].alias("found")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["spans"], moved).alias("spans"))

    starts = F.sequence(F.lit(1), F.size(matches), F.lit(BLOCK))
    blocks = F.transform(starts, lambda k: F.aggregate(F.slice(matches, k, F.lit(BLOCK)), F.struct(zero, none.alias("spans")), step))
    whole = F.aggregate(blocks, F.struct(zero, F.array().cast(f"array<{_SPANS}>").alias("spans")), joined)
    return F.when(F.size(matches) > 0, F.flatten(whole["spans"])).otherwise(none)


def _scored(kind: str, x: Column) -> Column:
    before = F.substring(F.col("t"), F.greatest(F.lit(1), (x["start"] - WINDOW + 1).cast("int")), F.least(F.lit(WINDOW), x["start"].cast("int")))
    sure = F.when(mod97(x["found"]), F.lit(0.3)).otherwise(F.lit(-0.6)) if kind == "iban" else F.lit(0.0)
    return F.lit(START[kind]) + sure + F.when(before.rlike(CONTEXT[kind]), FOR).otherwise(0.0) - F.when(before.rlike(AGAINST), LESS).otherwise(0.0)


def _confirmed(kind: str) -> Column:
    return F.filter(kind, lambda x: _valid(kind, x["found"]))


def _likely(kind: str, taken: Column) -> Column:
    """Spans of an added kind that score enough and meet none of the base kinds."""
    meets = lambda x: F.exists(taken, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return F.filter(kind, lambda x: (_scored(kind, x) >= LEAST_SCORE) & ~meets(x))


def _listed(kind: str, spans: Column, base: bool) -> Column:
    score = lambda x: F.lit(1.0) if base else F.round(F.least(F.lit(1.0), _scored(kind, x)), 4)
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score(x).alias("score")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): array of (kind, start, end, score), by kind as in KINDS and then by start."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    none = F.array().cast("array<struct<piece:string,found:string>>")
    # One pass tells which texts have digits at all; the patterns run on those only.
    digit = F.col("t").rlike("[0-9]")
    may = {k: F.contains("t", F.lit(x)) for k, x in NEEDS.items()} | {"iban": F.col("t").rlike("[A-Z]{2}[0-9]{2}")}
    df = df.withColumns({k: F.when(may.get(k, digit), _matches(k)).otherwise(none) for k in KINDS})
    df = df.withColumns({k: _spans(k) for k in KINDS})
    df = df.withColumns({k: _confirmed(k) for k in KINDS})
    base = KINDS[:4]
    taken = F.concat(*base)
    df = df.select("id", "t", *base, *(_likely(k, taken).alias(k) for k in KINDS[4:]))
    return df.select(F.col("id").alias(id_col), F.concat(*(_listed(k, F.col(k), k in base) for k in KINDS)).alias("spans"))


def op4_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:4]))
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[4:]),
    )
