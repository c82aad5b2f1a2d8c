"""Text functions as Column expressions: tokens, normal forms, domains, negation, change, years, chunks, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions import vocab as V


def words(pattern: str) -> str:
    """A pattern for whole words, case-insensitive, with Unicode word boundaries."""
    return rf"(?iU)\b(?:{pattern})\b"


def parts(listed: str) -> str:
    return "|".join(listed.split())


def tokens(c: Column) -> Column:
    """Latin words (ASCII letters, digits, _; lower case; two letters or more; no stop words) and pairs of neighbouring CJK
    letters (a lone one by itself), in order, repeats kept.  Null gives an empty array."""
    text = F.coalesce(c, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+|[\\u4e00-\\u9fff]+)"), F.lit(1))
    none = F.array().cast("array<string>")

    def of(x: Column) -> Column:
        latin = F.when((F.length(x) > 1) & ~F.lower(x).isin(V.STOP_WORDS), F.array(F.lower(x))).otherwise(none)
        pairs = F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
        return F.when(x < "\u4e00", latin).when(F.length(x) == 1, F.array(x)).otherwise(pairs)

    # a text without CJK letters, and without the two others whose lower case has ASCII letters, needs nothing done for each word
    plain = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]{2,})"), F.lit(1)), lambda x: ~x.isin(V.STOP_WORDS))
    return F.when(text.rlike("[\\u4e00-\\u9fff\\u0130\\u212a]"), F.flatten(F.transform(runs, of))).otherwise(plain)


def normal(c: Column) -> Column:
    """White space collapsed, case folded: equal for texts that say the same."""
    return F.replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def injection(c: Column) -> Column:
    """Number (from 1) of the first injection shape that a text has; null if none."""
    return F.coalesce(*(F.when(c.rlike(p), F.lit(k)) for k, p in enumerate(V.INJECTIONS, 1)))


def negated(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), F.lit(1))
    return c.rlike(parts(V.NEGATION_PARTS)) | F.exists(found, lambda w: w.isin(V.NEGATION_WORDS) | w.endswith("n't"))


def domain(c: Column) -> Column:
    """The first domain of facts that a text names; null if none."""
    by_part = [F.when(c.rlike(parts(p)), F.lit(d)) for d, p in V.DOMAIN_PARTS.items()]
    by_word = [F.when(c.rlike(words(p)), F.lit(d)) for d, p in V.DOMAIN_WORDS.items()]
    return F.coalesce(*by_part, *by_word)


def latin(c: Column) -> Column:
    """Whether at least four fifths of a text's letters are ASCII; false without letters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.coalesce((letters > 0) & (F.length(F.regexp_replace(c, "[^A-Za-z]", "")) / letters >= 0.8), F.lit(False))


def stem(w: Column) -> Column:
    plural = w.endswith("s") & (F.length(w) > 3) & ~w.rlike("(ss|us|is|as|sh|ch|x|z)$")
    return F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when(plural, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def content_words(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(V.CONTENT_STOP)))


def stems(c: Column) -> Column:
    return F.array_distinct(F.transform(content_words(c), stem))


def pronoun(c: Column) -> Column:
    """The first personal pronoun among a text's first four words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))
    return F.get(F.filter(F.slice(found, 1, 4), lambda w: w.isin(V.PRONOUNS)), 0)


def revoked(c: Column) -> Column:
    """A known fact is taken back."""
    chinese = c.rlike("了|再") & c.rlike(parts(V.REVOKE_PARTS))
    return domain(c).isNotNull() & (chinese | c.rlike(words(V.REVOKE_WORDS)) | (c.rlike(words(V.MARKER_WORDS)) & negated(c)))


def changed(c: Column) -> Column:
    """A text says that something changed."""
    return revoked(c) | c.rlike(parts(V.CHANGE_PARTS)) | c.rlike(words("|".join([V.MARKER_WORDS, V.CHANGE_WORDS, V.REVOKE_WORDS])))


def opposite(a: Column, b: Column) -> Column:
    """The pair of opposites of which each text has one; null if none."""
    chinese = [F.when((a.contains(x) & b.contains(y)) | (a.contains(y) & b.contains(x)), F.lit(f"{x}/{y}")) for x, y in V.OPPOSITE_PARTS]
    english = [F.when((a.rlike(words(x)) & b.rlike(words(y))) | (a.rlike(words(y)) & b.rlike(words(x))), F.lit("en-opposite")) for x, y in V.OPPOSITE_WORDS]
    return F.coalesce(*chinese, *english)


def triple_key(c: Column) -> Column:
    """Subject and relation of a structured triple (ids before names), lower case, joined by a tab; null if it is none."""
    def key(a: str, b: str) -> Column:
        pattern = rf'"{a}"\s*:\s*"([^"]+)"\s*,\s*"{b}"\s*:\s*"([^"]+)"'
        return F.when(c.rlike(pattern), F.lower(F.concat_ws("\t", F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2))))

    return F.when(c.contains('"subject"'), F.coalesce(key("subject_id", "relation_id"), key("subject", "relation")))


def years(c: Column) -> Column:
    """Years that a text names, in order."""
    found = F.regexp_extract_all(c, F.lit(r"(20\d\d年|(?i:in|during) (?:(?i:the year) )?20\d\d)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_extract(x, r"(20\d\d)", 1).cast("int"))


def is_rule(c: Column) -> Column:
    return c.rlike(V.RULE_PARTS) | c.rlike(words(V.RULE_WORDS))


def chunks(c: Column, most: int = V.CHUNK_MAX, least: int = V.CHUNK_MIN) -> Column:
    """Sentence-complete blocks of a text longer than ``most``: a block closes when the next sentence doesn't fit and it has
    ``least`` letters.  Shorter texts, and those without a sentence end inside, are one block."""
    sentences = F.filter(F.split(c, "(?<=[。！？；.!?\n])"), lambda s: (F.length(F.regexp_replace(s, r"(?U)\s+", "")) > 0) | s.contains("\n"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        full = (F.length(acc["now"]) + F.length(s) > most) & (F.length(acc["now"]) >= least)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(F.concat(acc["now"], s)).alias("now"))

    folded = F.aggregate(sentences, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    blocks = F.filter(F.transform(folded, strip), lambda b: F.length(b) > 0)
    return F.when((F.length(c) > most) & (F.size(sentences) > 1), blocks).otherwise(F.array(c))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def point(c: Column, most: int = V.POINT_CHARS) -> Column:
    """The first line that says something, cut to ``most`` letters."""
    lines = F.filter(F.transform(F.split(strip(c), "\n"), strip), lambda x: F.length(x) > 0)
    telling = F.filter(lines, lambda x: ~x.rlike(V.GREETING) | (F.length(x) >= 12))
    head = F.coalesce(F.get(telling, 0), F.get(lines, 0), F.lit(""))
    return F.when(F.length(head) <= most, head).otherwise(F.concat(F.regexp_replace(F.substring(head, 1, most), r"(?U)\s+$", ""), F.lit("…")))


def rolled(points: Column, most: int = V.SUMMARY_CHARS, head: int = V.SUMMARY_HEAD) -> Column:
    """An ordered array of points folded into a running summary: each new line once; too long a text keeps head and tail."""
    def step(acc: Column, p: Column) -> Column:
        text = F.when(acc == "", p).otherwise(F.concat(acc, F.lit("\n"), p))
        cut = F.concat(F.substring(text, 1, head), F.lit("\n…\n"), F.right(text, F.lit(most - head - 3)))
        return F.when((p == "") | F.array_contains(F.split(acc, "\n"), p), acc).otherwise(F.when(F.length(text) <= most, text).otherwise(cut))

    return F.aggregate(points, F.lit(""), step)
