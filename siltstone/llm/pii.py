"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score; DataFrame functions only.

Base kinds follow the contract and always stay. Each pattern below finds the same spans as the contract's plain
one, leftmost and without overlap, but with possessive quantifiers and boundaries, so that the JVM's matcher
neither recurses nor retries inside a run. A card's pattern takes maximal digit chains of 12 to 19 digits, for
those are what the plain pattern takes before its length test.

The method adds `iban` (mod 97) and `ssn` (needs a context word). A span's score starts at its kind's prior, rises
when a checksum confirms it and when a context word stands in the `NEAR` characters before it; added kinds need
`LEAST`. Positions count code points; they come from the lengths of what stands between the matches, and so does the text
before a match, so that time is near linear in the spans of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import table

NEAR, LEAST = 40, 0.7
#: kind -> (pattern, a plain guard, test of the match m, prior, gain of a passed checksum, context words); base kinds first, in the order of the contract.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true", 0.8, 0.0, "mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 and int(concat('0', right(ltrim('0', p), 3))) <= 255)", 0.6, 0.0, "ip|host|server|address|login"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])", None, "{luhn}", 0.3, 0.5, "card|visa|master|credit|pay"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15", 0.6, 0.0, "tel|phone|call|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])", None, "{mod97}", 0.3, 0.5, "iban|bank|account|transfer"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "not (m rlike '^(000|666|9)|-00-|-0000$')", 0.5, 0.0, "ssn|social|security|tax"),
}
BASE = ("email", "ip", "card", "phone")
#: Luhn: from the right, every second digit counts double, less 9 if over 9.
LUHN = (
    "aggregate(transform(split(reverse(regexp_replace(m, '[^0-9]', '')), ''), (c, i) -> "
    "case when i % 2 = 0 then int(c) when int(c) < 5 then 2 * int(c) else 2 * int(c) - 9 end), 0, (a, d) -> a + d) % 10 = 0"
)
#: ISO 7064 mod 97: the first four characters go to the end, letters count 10 to 35.
MOD97 = (
    "aggregate(split(concat(substr(replace(m, ' ', ''), 5), left(replace(m, ' ', ''), 4)), ''), 0, (a, c) -> "
    "case when c between '0' and '9' then (a * 10 + int(c)) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1"
)


def _kind(kind: str, rank: int, text: str) -> Column:
    """The accepted spans of one kind: array of (start, rank, end, kind, score), ascending."""
    pattern, guard, test, prior, gain, words = KINDS[kind]
    test = test.format(luhn=LUHN, mod97=MOD97) if "{l" in test or "{mod" in test else test
    quoted = "r'" + pattern + "'"
    empty = "cast(array() as array<struct<start: int, rank: int, end: int, kind: string, score: double>>)"
    # a: the spans so far, in blocks of about the root of their number, so that appending copies few; near: the text before the match.
    start = "a.at + g.gap"
    near = f"right(concat(a.near, g.near), {NEAR})"
    score = f"least(1d, {prior}d + {gain}d + if(lower({near}) rlike '{words}', 0.2d, 0d))"
    row = f"named_struct('start', {start}, 'rank', {rank}, 'end', {start} + length(g.m), 'kind', '{kind}', 'score', {score})"
    fits = "true" if kind in BASE else f"{score} >= {LEAST}d"
    passed = f"exists(array(g.m), m -> {test})"
    state = lambda at, near, out: f"named_struct('at', {at}, 'near', {near}, 'out', {out})"
    step = state("if(g.m is null, a.at, a.at + g.gap + length(g.m))", f"if(g.m is null, a.near, right(concat({near}, g.m), {NEAR}))", f"case when g.m is null then a.out when not ({passed}) then a.out when not ({fits}) then a.out else array_append(a.out, {row}) end")
    found = f"zip_with(regexp_extract_all({text}, {quoted}, 0), split({text}, {quoted}, -1), (m, p) -> named_struct('m', m, 'gap', length(p), 'near', right(p, {NEAR})))"
    blocks = "transform(sequence(0, cast(sqrt(size(z)) as int)), i -> slice(z, i * cast(sqrt(size(z)) + 1 as int) + 1, cast(sqrt(size(z)) + 1 as int)))"
    inner = f"aggregate(block, {state('whole.at', 'whole.near', empty)}, (a, g) -> {step}, a -> {state('a.at', 'a.near', 'concat(whole.out, a.out)')})"
    outer = f"aggregate({blocks}, {state('0', chr(39) * 2, empty)}, (whole, block) -> {inner}).out"
    spans = f"element_at(transform(array({found}), z -> {outer}), 1)"
    there = f"contains({text}, '{guard}') and {text} rlike {quoted}" if guard else f"{text} rlike {quoted}"
    return F.expr(f"case when {there} then {spans} else {empty} end")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds to the id column `entities`: array of (start, rank, end, kind, score) by start, then kind; end is exclusive.

    Null or empty text has none. Rows stay as they are, repeated ones included; other columns are ignored.
    """
    x = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = [_kind(k, i, "t").alias(k) for i, k in enumerate(KINDS)]
    return x.select("doc_id", *found).select("doc_id", F.array_sort(F.concat(*KINDS)).alias("entities"))


def op5_pii(spark, sf_dir):
    joined = lambda xs: f"array_join(transform({xs}, e -> concat_ws(':', e.kind, e.start, e.end)), ',')"
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.expr(f"cast(size(filter(entities, e -> e.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE],
        F.expr(f"sha2({joined('filter(entities, e -> e.rank < 4)')}, 256)").alias("base_sha256"),
        F.expr(joined("entities")).alias("spans"),
        F.expr("transform(entities, e -> round(e.score, 3))").alias("scores"),
    )
