"""Personal data: patterns propose spans, validators confirm them, context words adjust the score. Built-in functions only.

Patterns are written so that the regular expression engine reads each text once: runs are possessive, and a run is
entered only at its start or where the last match ended. Matches and what stands between them (`split`) give positions
without a search, and the context is the end and the start of what stands around a match.

The first four kinds are the base: they are reported whenever their validator agrees. The others are reported when their
validator agrees and their score, raised by context words, reaches `LEAST`.

Defined cases: null text is empty; an empty text has no spans; repeated rows are searched each; a null id and any other
columns are passed on; no rows give no rows. `redact` changes `text` (null becomes empty) and `n_chars`, if there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind: pattern, what a text must hold to be searched, score, context words that raise it. Fixed values of the contract: the first four patterns.
KINDS = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write|reach"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", 0.6, "ip|address|host|server|login|client"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "digit", 0.7, "card|visa|master|credit|debit|pay|amex"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|tel|call|mobile|fax|cell"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "digit", 0.7, "iban|bank|account|transfer"),
    "ssn": (r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", "-", 0.3, "ssn|social security|tax"),
    "tel": (r"(?<![A-Za-z0-9+().-])(?:\([0-9]{3}\)\x20|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![A-Za-z0-9-])", "digit", 0.3, "phone|tel|call|mobile|fax|cell"),
}
BASE = ["email", "ip", "card", "phone"]
LEAST, BONUS, BEFORE, AFTER = 0.5, 0.3, 40, 20
_STEP = 128
_BLOCK = 1024


def running(values: Column, add=lambda a, x: a + x, first: int = 0) -> Column:
    """Running sums (or another associative fold) of an int array, in groups so that long arrays stay cheap."""
    def fold(xs, start):
        return F.aggregate(xs, start, add)

    def steps(xs, start):
        return F.aggregate(
            xs, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, x: F.struct(add(a["at"], x).alias("at"), F.concat(a["out"], F.array(add(a["at"], x))).alias("out")), lambda a: a["out"])

    groups = F.sequence(F.lit(0), ((F.size(values) - 1) / _STEP).cast("int"))
    part = lambda g: F.slice(values, g * _STEP + 1, _STEP)
    start = F.lit(first).cast("int")
    before = F.concat(F.array(start), steps(F.transform(groups, lambda g: fold(part(g), start)), start))
    full = F.flatten(F.zip_with(groups, F.slice(before, F.lit(1), F.size(before) - 1), lambda g, b: steps(part(g), b)))
    return F.when(F.size(values) > 0, full).otherwise(F.array().cast("array<int>"))


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of at most 19 digits."""
    plain = F.lpad(digits, 19, "0")
    doubled = F.translate(plain, "0123456789", "0246813579")
    digit = lambda s, i: F.substring(s, i, 1).cast("int")
    total = sum((digit(plain if i % 2 else doubled, i) for i in range(1, 20)), F.lit(0))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """The account number's check: its first four characters moved to the end, letters as 10 to 35, the rest by 97 is 1."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97)) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(hit)
    if kind == "ssn":
        return ~hit.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _found(kind: str) -> Column:
    """Confirmed spans of a kind from its matches (`h_`) and what stands between them (`c_`)."""
    _, _, score, context = KINDS[kind]
    hits, cuts = F.col(f"h_{kind}"), F.col(f"c_{kind}")
    n = F.size(hits)
    ends = running(F.zip_with(F.slice(cuts, F.lit(1), n), hits, lambda c, h: F.length(c) + F.length(h)))
    around = F.zip_with(F.slice(cuts, F.lit(1), n), F.slice(cuts, F.lit(2), n), lambda a, b: F.concat(F.right(a, F.lit(BEFORE)), F.lit(" "), F.left(b, F.lit(AFTER))))
    placed = F.zip_with(F.zip_with(hits, ends, lambda h, e: F.struct(h.alias("h"), e.alias("e"))), around, lambda x, a: F.struct(
        F.lit(kind).alias("kind"), (x["e"] - F.length(x["h"])).alias("start"), x["e"].alias("end"),
        F.when(_confirmed(kind, x["h"]), score + F.when(F.lower(a).rlike(rf"\b(?:{context})"), BONUS).otherwise(0.0)).otherwise(0.0).cast("double").alias("score")))
    good = F.filter(placed, lambda s: s["score"] >= (0.1 if kind in BASE else LEAST))
    return F.when(n > 0, F.transform(good, lambda s: s.withField("score", F.least(F.round(s["score"], 2), F.lit(1.0))))).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def spans(docs: DataFrame) -> DataFrame:
    """(row, text, found): each document as a struct, its text without null, and its spans by kind, then start.

    Positions are code points, the end is exclusive.
    """
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("digit", F.col("text").rlike("[0-9]"))
    empty = F.array().cast("array<string>")
    gate = lambda needs: F.col("digit") if needs == "digit" else F.col("text").contains(needs) & (F.lit(True) if needs == "@" else F.col("digit"))
    df = df.withColumns({f"h_{k}": F.when(gate(needs), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(empty) for k, (p, needs, _, _) in KINDS.items()})
    df = df.withColumns({f"c_{k}": F.when(F.size(f"h_{k}") > 0, F.split("text", p, -1)).otherwise(empty) for k, (p, _, _, _) in KINDS.items()})
    return df.select("row", "text", F.concat(*(_found(k) for k in KINDS)).alias("found"))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, all spans and their scores, for each document."""
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"].isin(BASE))
    return spans(docs).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), *(_count(found, k).alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(found).alias("spans"),
        F.array_join(F.transform(found, lambda s: s["score"].cast("string")), ",").alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each stretch of personal data replaced by its kind in brackets; overlapping spans leave together."""
    df = spans(docs)
    ordered = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    df = df.select("row", "text", ordered.alias("found"))
    some = F.size("found") > 0
    reach = F.concat(F.array(F.lit(0)), running(F.transform("found", lambda s: s["end"]), lambda a, x: F.greatest(a, x)))
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    df = df.withColumns({"reach": F.when(some, reach), "blocks": F.when(some, blocks)})

    def cut(a: Column, b: Column) -> Column:
        """Code points from a to b, through blocks, so that a long text is not walked once per span."""
        first, last = (a / _BLOCK).cast("int"), ((b - 1) / _BLOCK).cast("int")
        block = lambda i: F.element_at("blocks", i + 1)
        within = F.substr(block(first), a % _BLOCK + 1, b - a)
        across = F.concat(F.substr(block(first), a % _BLOCK + 1), F.array_join(F.slice("blocks", first + 2, last - first - 1), ""), F.substr(block(last), F.lit(1), b - last * _BLOCK))
        return F.when(a >= b, "").when(first == last, within).otherwise(across)

    pieces = F.zip_with(F.slice("reach", F.lit(1), F.size("found")), F.col("found"), lambda r, s: F.when(
        s["start"] >= r, F.concat(cut(r, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
    text = F.when(some, F.concat(F.array_join(pieces, ""), cut(F.element_at("reach", -1), F.length("text")))).otherwise(F.col("text"))
    df = df.select("row", text.alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return df.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
