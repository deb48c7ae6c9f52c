"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. A pattern's matches come with the text between them (``split`` on the same pattern), so
places are running sums of lengths in code points; matches are dealt as rows and summed per document, and only
those rows move. Patterns are written possessively and start at the head of a run of their characters, so they take
linear time on any text.

Kinds, in the order of their listing: ``email``, ``ip`` (each part at most 255), ``card`` (16 to 19 digits passing
Luhn) and ``phone`` (8 to 15 digits) are the base and always reported; ``iban`` (mod-97 passing), ``shortcard`` (13
to 15 digits passing Luhn) and ``ssn`` (no checksum exists) are the method's own and are reported when their score
reaches ``MIN_SCORE``. The score is a prior for the kind, plus what a passed checksum is worth, plus or minus what
the words within ``NEAR`` code points of the match say, up to a neighbouring match of the same pattern that is confirmed too;
other numbers between do not end the context.

An ``iban`` has its country's length (``IBAN_LENGTHS``), so it never takes the word or number behind it. Two letters
that name no country of the table keep an open length, which stops before an IBAN of the table.

Edge cases: null counts as empty; an empty text has no spans; repeated rows are reported row by row; equal spans of
different kinds are both reported; a failing match is dropped and its characters are not tried again; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "shortcard", "ssn")
MIN_SCORE = 0.7
NEAR = 48

#: Rows on either side that hold a match's context: a match with the gap before it is three characters or longer.
NEAR_ROWS = NEAR // 3
#: Stands for a confirmed match in the text around another; no text keeps it.
STOP = "\x00"
#: Characters of an IBAN: the countries of the ISO 13616 registry and those that use the form without being in it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU"}


def _iban() -> str:
    group, end = r"(?:\x20?[A-Z0-9]{4})", r"(?![A-Za-z0-9])"
    rest = lambda n: (f"{group}{{{n // 4 - 1}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else ""))
    known = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}{rest(n)}" for n, c in IBAN_LENGTHS.items()) + f"){end}"
    codes = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    other = rf"(?!{codes})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{known}))?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?{end}"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|{other})"


_MAIL = r"A-Za-z0-9._%+-"
PATTERNS = {
    # A match starts at the head of a run or where the last match ended (\G); no other start can succeed.
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A plain substring or pattern without which the costly pattern can't match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.5, "phone": 0.6, "iban": 0.4, "shortcard": 0.2, "ssn": 0.5}
CHECKED = {"card": 0.4, "iban": 0.5, "shortcard": 0.3}
HELPS = {
    "email": r"(?i)\b(?:e-?mail|contact|write|mailto)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login)\b",
    "card": r"(?i)\b(?:card|credit|visa|mastercard|payment|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta|transfer)\b",
    "shortcard": r"(?i)\b(?:card|credit|amex|american express|diners|payment|karte|tarjeta|carte)\b",
    "ssn": r"(?i)\b(?:ssn|social security|social-security)\b",
}
HARMS = r"(?i)\b(?:isbn|issn|doi|version|order no|order number|invoice|serial|part no|example)\b"
WORTH = 0.3


def _luhn(digits: Column) -> Column:
    """Digits (a string of 13 to 19) pass the Luhn sum."""
    total = F.lit(0)
    for i in range(19):  # i-th digit from the right; beyond the string it is empty and counts 0
        d = F.coalesce(F.substr(F.reverse(digits), F.lit(i + 1), F.lit(1)).try_cast("int"), F.lit(0))
        total = total + (d if i % 2 == 0 else 2 * d - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def _mod97(iban: Column) -> Column:
    """ISO 13616: first four characters to the end, letters as 10..35, remainder 1 by 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    step = lambda r, c: F.when(c < "A", (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.length(plain).between(15, 34) & (F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), step) == 1)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _octets_fit(ip: Column) -> Column:
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return ip.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def _proposed(kind: str, text: Column) -> Column:
    """Array of (kind, k, skip, m, before, after): the k-th match, the length before it, and its surroundings."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("m"))
    rows = F.transform(zipped, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("k"), F.length(x["gap"]).alias("skip"), x["m"].alias("m"),
        F.right(x["gap"], F.lit(NEAR)).alias("before"), F.substring(x["gap"], 1, NEAR).alias("head")))
    here = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9]")
    return F.when(here, rows)


def _mark(col: str) -> Column:
    return F.concat_ws(":", "kind", "start", "end").alias(col)


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans, all spans with scores."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), text.alias("t"))
    for kind in PATTERNS:
        rows = rows.withColumn(kind, _proposed(kind, F.col("t")))
    none = F.array().cast(rows.schema["email"].dataType)
    dealt = rows.select("row", "doc_id", F.explode_outer(F.concat(*[F.coalesce(F.col(k), none) for k in PATTERNS])).alias("x")) \
        .select("row", "doc_id", "x.*")
    order = Window.partitionBy("row", "pattern").orderBy("k")
    n_digits = F.length(_digits(F.col("m")))
    kind = F.when((F.col("kind") == "card") & n_digits.between(13, 15), "shortcard").otherwise(F.col("kind"))
    fits = (F.when(F.col("kind") == "email", True)
            .when(F.col("kind") == "ip", _octets_fit(F.col("m")))
            .when(F.col("kind") == "card", n_digits.between(16, 19) & _luhn(_digits(F.col("m"))))
            .when(F.col("kind") == "shortcard", _luhn(_digits(F.col("m"))))
            .when(F.col("kind") == "phone", n_digits.between(8, 15))
            .when(F.col("kind") == "iban", _mod97(F.col("m")))
            .when(F.col("kind") == "ssn", ~F.col("m").rlike("^(?:000|666|9)|-00-|-0000$")))
    # the text on either side is put together again from the gaps and matches around; a confirmed match becomes STOP
    checked = dealt.withColumns({"pattern": F.col("kind"), "kind": kind}) \
        .withColumn("fits", F.coalesce(F.col("m").isNotNull() & fits, F.lit(False)))
    text_of = lambda c: F.translate(F.coalesce(c, F.lit("")), STOP, " ")
    match = lambda part: F.when(F.col("fits"), F.lit(STOP)).otherwise(text_of(part))
    left = F.collect_list(F.concat(text_of(F.col("before")), match(F.right("m", F.lit(NEAR))))).over(order.rowsBetween(-NEAR_ROWS, -1))
    right = F.collect_list(F.concat(text_of(F.col("head")), match(F.substring("m", 1, NEAR)))).over(order.rowsBetween(1, NEAR_ROWS))
    placed = checked.withColumns({
        "end": F.sum(F.col("skip") + F.coalesce(F.length("m"), F.lit(0))).over(order),
        "near": F.concat_ws(" ", F.right(F.substring_index(F.concat_ws("", left, text_of(F.col("before"))), STOP, -1), F.lit(NEAR)),
                            F.substring(F.substring_index(F.concat_ws("", right), STOP, 1), 1, NEAR))})
    by_kind = lambda values, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]),
                                                            F.col("kind")), F.lit(other))
    helps = F.lit(False)
    for k, pattern in HELPS.items():
        helps = helps | ((F.col("kind") == k) & F.col("near").rlike(pattern))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), by_kind(PRIOR, 0.0) + by_kind(CHECKED, 0.0)
                                           + F.when(helps, WORTH).otherwise(0.0)
                                           - F.when(F.col("near").rlike(HARMS), WORTH).otherwise(0.0)))
    base = F.col("kind").isin(*BASE)
    judged = placed.withColumn("score", score).withColumn("start", F.col("end") - F.length("m"))
    taken = F.col("fits") & (base | (F.col("score") >= min_score))
    span = F.when(taken, F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("place"), "start", "end",
                                  "kind", F.round("score", 2).alias("score")))
    per_doc = judged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("found"),
        *[F.count(F.when(taken & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE])
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    joined = lambda spans, of: F.array_join(F.transform(spans, of), ",")
    base_spans = F.filter("found", lambda s: s["place"] <= len(BASE))
    return per_doc.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(joined(base_spans, name).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found"), name).alias("spans"),
        joined(F.col("found"), lambda s: F.concat_ws(":", name(s), s["score"].cast("string"))).alias("scored_spans"))
