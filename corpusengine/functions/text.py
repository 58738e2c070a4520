"""Column -> Column functions on text, tokens, numbers and hashes. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content when questions are compared.
STOPWORDS = (
    "the a an is are was were be been being "
    "what which who whom how why when where "
    "does do did this that these those "
    "of in on to for and or as with from "
    "by at it its according paper please"
).split()
WORD = r"([\p{L}\p{N}_]+)"
PLAIN_WORD = r"([a-z0-9]+)"
PERSONAL, QUANTIFIER, ACRONYM = r"(?i)\b(my|our|i|me)\b", r"\b(one|two|three|four|five|six|seven|eight|nine|ten|\d+)\b", r"(?<![\p{L}\p{N}_])([A-Z]{2,6})(?![\p{L}\p{N}_])"


def decimal_points(text: Column) -> Column:
    """A comma between digits becomes a point."""
    return F.regexp_replace(text, r"(?<=\d),(?=\d)", ".")


def join_hyphenated_lines(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z])-\n([a-z])", "$1$2")


def label_positional_row(text: Column, name: str, labels: list[str]) -> Column:
    """``name`` followed by one value a line becomes ``name: label1=v1, label2=v2``."""
    import re

    values = r"\s*\n\s*".join([r"([0-9][0-9.,%]*)"] * len(labels))
    named = ", ".join(f"{label}=${k}" for k, label in enumerate(labels, 1))
    return F.regexp_replace(text, re.escape(name) + r"\s*\n\s*" + values, f"{name}: {named}")


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s]+|[\s]+$", "")


def chunker_form(text: Column) -> Column:
    """LF line ends, runs of spaces and tabs as one space, no blanks at the ends."""
    return strip_blanks(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "[ \t]+", " "))


def sanitise_html(html: Column) -> Column:
    no_script = F.regexp_replace(html, "(?i)<script[^>]*>.*?</script>", "")
    return strip_blanks(F.replace(F.regexp_replace(no_script, "<[^>]+>", ""), F.lit("\x00"), F.lit("")))


def valid_email(email: Column) -> Column:
    return F.coalesce(F.lower(email).rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"), F.lit(False))


def filename_words(name: Column) -> Column:
    """No last extension, lower case, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, r"\.\w+$", "")), "[^a-z0-9]+", " "))


def entity_name(entity: Column) -> Column:
    """A row label without what follows ``(`` or ``w/o``, and without spaces and dashes around."""
    return F.regexp_replace(F.split(entity, r"\(| w/o |w/o ")[0], r"^[ -]+|[ -]+$", "")


def field_token(name: Column) -> Column:
    """Lower case, no spaces, every arrow as ``->``."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\s+", ""), "→|-*>", "->")


def number_token(number: Column) -> Column:
    """A number as text of ten significant digits at most (minus signs, percent and commas unified), null if it is none or not finite.

    Without trailing zeros; with an exponent below 1e-4 and from 1e10 on. Texts that have ten
    digits at most, and no zero in front, lose trailing zeros as they stand; others are parsed.
    """
    bare = F.translate(F.trim(number), "−–,%", "--")
    value = bare.try_cast("double")
    value = F.when(F.abs(value) < float("inf"), value)
    shown = F.format_string("%.9e", F.abs(value))
    digits = F.concat(F.substring(shown, 1, 1), F.substring(shown, 3, 9))
    power = F.substring_index(shown, "e", -1).try_cast("int")
    cut = lambda t: F.regexp_replace(t, r"\.?0*$", "")
    large = F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    scientific = F.concat(cut(F.substring_index(shown, "e", 1)), F.lit("e"), F.substring_index(shown, "e", -1))
    plain = F.when(value == 0, "0").when((power < -4) | (power >= 10), scientific).when(power >= 0, cut(large)).otherwise(cut(small))
    parsed = F.when(value.isNotNull(), F.concat(F.when(value < 0, "-").otherwise(""), plain))
    pointed, whole = bare.rlike(r"^-?[1-9](?=[\d.]{1,10}\z)\d*\.\d*\z"), bare.rlike(r"^-?[1-9]\d{0,9}\z")
    return F.when(pointed, F.rtrim(F.rtrim(bare, F.lit("0")), F.lit("."))).when(whole, bare).otherwise(parsed)


def without_references(text: Column) -> Column:
    """``Figure 2``, ``Table 1`` and the like removed."""
    return F.regexp_replace(text, r"(?i)\b(figure|fig\.?|table|section|chapter|page|equation|eq\.?)\s*\d+(\.\d+)*", "")


def annotate_ranges(text: Column) -> Column:
    """Each ``from a to b when c`` adds a line that names start, end and condition."""
    pattern = r"(?i)from\s+([0-9][\w.%]*)\s+to\s+([0-9][\w.%]*)\s+when\s+([^.;\n]+)"
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    notes = F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "abc", strict=True)]), lambda x: F.concat(F.lit("[Range: start="), x["a"], F.lit(", end="), x["b"], F.lit(", condition="), F.trim(x["c"]), F.lit("]")))
    return F.when(F.size(notes) > 0, F.concat_ws("\n", text, F.array_join(notes, "\n"))).otherwise(text)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least, none for null or empty."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def words(text: Column) -> Column:
    """Lower-cased words for the keyword index."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def content_words(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN_WORD), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, STOPWORDS)))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word sets, 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def cache_key(user: Column, question: Column, version: Column) -> Column:
    return F.concat(F.lit("querycache:"), F.md5(F.lower(F.concat_ws(":", user, question, version))))


def change_hash(value: Column) -> Column:
    """Hash of a value's JSON with keys sorted at every depth, so maps that are equal hash the same."""
    return F.substring(F.md5(F.to_json(F.parse_json(F.to_json(F.struct(value.alias("v")))))), 1, 12)


def total_tokens(texts: Column) -> Column:
    """Token estimate of an array of messages."""
    return F.aggregate(F.coalesce(texts, F.array().cast("array<string>")), F.lit(0), lambda a, t: a + estimate_tokens(t))


def embedding_input(task: str, text: Column) -> Column:
    if task not in ("search_document", "search_query"):
        raise ValueError(f"unknown task {task}")
    return F.concat_ws(": ", F.lit(task), text)


def point_id(doc_id: Column, chunk_index: Column) -> Column:
    """UUID version 5 of ``doc_chunk`` in the DNS namespace, so a retry writes the same row."""
    namespace = "6ba7b8109dad11d180b400c04fd430c8"
    name = F.concat_ws("_", doc_id.cast("string"), chunk_index.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    fourth = F.substr(variant, F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), fourth, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def is_object(text: Column) -> Column:
    """``text`` is exactly one JSON object; nothing stands behind it (a parser would stop there)."""
    alone = F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<variant>")) == 1
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(text.startswith("{") & text.endswith("}") & alone & inside, F.lit(False))


def balanced_object(text: Column) -> Column:
    """From the first brace to the one that closes it; braces in strings don't count. Null if none closes it."""
    rest = F.substr(text, F.instr(text, "{"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(a: Column, c: Column) -> Column:
        mark, plain = (c == '"') & ~a["escaped"], ~a["quoted"]
        depth = a["depth"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
        end = F.when((a["end"] == 0) & plain & (c == "}") & (depth == 0), a["at"] + 1).otherwise(a["end"])
        return F.struct((a["at"] + 1).alias("at"), depth.alias("depth"), F.when(mark, plain).otherwise(a["quoted"]).alias("quoted"), (a["quoted"] & (c == "\\") & ~a["escaped"]).alias("escaped"), end.alias("end"))

    end = F.aggregate(F.split(rest, ""), start, step)["end"]
    return F.when((F.instr(text, "{") > 0) & (end > 0), F.substr(rest, F.lit(1), end))


def object_of(response: Column) -> Column:
    """The JSON object text of a model's raw response: as it is, without fences, or its first balanced object; null if none parses."""
    plain = F.trim(response)
    bare = F.trim(F.regexp_replace(F.regexp_replace(plain, r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    inner = balanced_object(response)
    return F.when(is_object(plain), plain).when(is_object(bare), bare).when(is_object(inner), inner)


def parse_stage(response: Column) -> Column:
    plain = F.trim(response)
    found = object_of(response)
    return F.when(found.isNull(), "failed").when(found == plain, "direct").when(plain.startswith("```"), "fenced").otherwise("embedded")


def named_sources(response: Column, known: list[str]) -> tuple[Column, Column]:
    """Registered names of a JSON list (bare, fenced or under ``sources``), in order; and the dropped ones."""
    listed = F.regexp_extract(response, r"(?s)(\[[^\[\]]*\])", 1)
    names = F.transform(F.from_json(listed, "array<string>"), lambda x: F.lower(F.trim(x)))
    names = F.array_distinct(F.coalesce(names, F.array().cast("array<string>")))
    registry = F.array(*map(F.lit, known))
    return F.array_intersect(names, registry), F.array_except(names, registry)


def metadata_record(response: Column) -> Column:
    """title, authors and affiliations of a JSON response, null without a title."""
    got = F.from_json(object_of(response), "title string, authors array<string>, affiliations array<string>")
    return F.when(F.length(F.trim(got["title"])) > 0, got)


def first_true(rules: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule whose condition holds; one pass, no UDF."""
    out = F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(condition, F.lit(value) if not isinstance(value, Column) else value).otherwise(out)
    return out
