"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: abbreviations after which no sentence ends, and honorifics
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "vs", "etc", "e.g", "i.e")
HONORIFICS = (r"Mr\.?", r"Mrs\.?", r"Ms\.?", r"Dr\.?", r"Prof\.?", "Sir", "Lord", "Lady")

_ABBREVIATION = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
SENTENCE_END = rf"(?<=[.!?])(?<!\b(?i:{_ABBREVIATION})\.)\s+(?=[A-Z0-9\"'(\[])"


def normalize(text: Column) -> Column:
    """Lower case, white space (of any kind) collapsed to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def non_empty(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: strip(x)), lambda x: x != "")


def char_grams(text: Column, k: int = 3) -> Column:
    """Distinct character k-grams; none for a shorter text or null. One scan: each match looks ahead by k and moves on by
    one character."""
    grams = F.regexp_extract_all(text, F.lit(rf"(?s)(?=({'.' * k}))."), F.lit(1))
    return F.coalesce(F.array_distinct(grams), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sentences(text: Column) -> Column:
    """Sentences; an abbreviation's full stop ends none, and no empty ones are returned."""
    return non_empty(F.split(text, SENTENCE_END))


def sentences_around_tables(text: Column) -> Column:
    """Sentences, with each run of table lines (those beginning with ``|``) kept as one."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?:(?:^|(?<=\n))[ \t]*\|[^\n]*(?:\n|$))+|(?:(?:^|(?<=\n))(?![ \t]*\|)[^\n]*(?:\n|$))+"), F.lit(0))
    parts = F.transform(blocks, lambda b: F.when(F.ltrim(b).startswith("|"), F.array(F.trim(F.regexp_replace(b, r"\n$", "")))).otherwise(sentences(b)))
    return F.filter(F.flatten(parts), lambda x: x != "")


def heading_sections(text: Column) -> Column:
    """Sections that begin at headings of depth 1 to 3; by blank lines where there is one only."""
    by_blank_lines = non_empty(F.split(text, r"\n\s*\n"))
    return held(non_empty(F.split(text, r"(?m)(?=^#{1,3}\s+)")), lambda parts: F.when(F.size(parts) > 1, parts).otherwise(by_blank_lines))


def heading(text: Column) -> Column:
    """(text, depth) of the first heading of depth 1 to 6; nulls without one."""
    pattern = r"(?m)^(#{1,6})\s+(.+)$"
    depth = F.length(F.regexp_extract(text, pattern, 1))
    return F.struct(
        F.when(depth > 0, F.trim(F.regexp_extract(text, pattern, 2))).alias("text"), F.when(depth > 0, depth).alias("depth")
    )


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def terms(text: Column) -> Column:
    """Search terms: lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def token_count(text: Column, tokenize: Callable[[Column], Column] = words) -> Column:
    """Tokens of a text by ``tokenize``, which makes an array of a text column; words by default."""
    return F.size(tokenize(text))


def budget_tokens(text: Column) -> Column:
    """The token estimate of context budgets: a quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("int")


def format_element(category: Column, depth: Column, text: Column) -> Column:
    """An element as Markdown-like text by its category."""
    marks = F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce(depth, F.lit(1)), F.lit(1)), F.lit(6)))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(""))
        .when(category == "Title", F.concat(marks, F.lit(" "), text))
        .when(category == "Table", F.concat(F.lit("[TABLE]\n"), text, F.lit("\n[/TABLE]")))
        .when(category == "Image", F.concat(F.lit("[IMAGE_DESCRIPTION]\n"), text, F.lit("\n[/IMAGE_DESCRIPTION]")))
        .when(category.startswith("ListItem") & ~text.startswith("-"), F.concat(F.lit("- "), text))
        .otherwise(text)
    )


def sha(*parts: Column | str) -> Column:
    """Hex SHA-256 of the parts joined by ``::``; the identifier of everything derived from content."""
    return F.sha2(F.concat_ws("::", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def entity_id(kind: Column, name: Column) -> Column:
    return sha(kind, F.lower(F.trim(name)))


def edge_id(source: Column, relation: Column, target: Column) -> Column:
    return sha(source, relation, target)


def community_id(level: Column, label: Column) -> Column:
    return sha(level.cast("string"), label.cast("string"))


def leading_id(hex_id: Column) -> Column:
    """First 64 bits of a hex id as an unsigned decimal string; it can exceed a LONG."""
    return F.conv(F.substring(hex_id, 1, 16), 16, 10)


def strip_honorific(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, rf"(?i)^\s*(?:{'|'.join(HONORIFICS)})\s+", ""))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used (even inside lambdas)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def capital_words(text: Column) -> Column:
    """All capitalised words of at least three letters."""
    return F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-zA-Z]{2,}(?![\p{L}\p{N}_])"), F.lit(0))


def capitalised(text: Column) -> Column:
    """Capitalised words of at least three letters, first spelling of each, case-insensitively distinct.

    The words are sorted by lower case and place, so that one scan tells the first of each; then by place again.
    """
    placed = F.array_sort(F.transform(capital_words(text), lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    firsts = held(placed, lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["k"] != e["k"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda e: F.struct(e["i"], e["x"]))), lambda e: e["x"])


_CITE = r"\[CITE:([^\]]+)\]"


def _cited(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(_CITE), F.lit(1)), lambda x: F.trim(x))


def citation_ids(answer: Column) -> Column:
    """Ids of ``[CITE:id]`` marks in order of first appearance; their places are the citations' numbers."""
    return F.array_distinct(_cited(answer))


def numbered_citations(answer: Column) -> Column:
    """``[CITE:id]`` marks replaced by ``[n]``."""
    cited, ids = _cited(answer), citation_ids(answer)
    number = F.transform(cited, lambda x: F.concat(F.lit("["), F.array_position(ids, x).cast("string"), F.lit("]")))
    gaps = F.split(answer, _CITE, -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.try_element_at(number, i + 1), F.lit("")))), "")


def has_citation(answer: Column) -> Column:
    return F.when(answer.rlike(r"\[\d+\]"), 1.0).otherwise(0.0)


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whole-word presence, case-insensitive; the phrase is taken literally."""
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(?U)\b\Q"), F.lower(phrase), F.lit(r"\E\b")))


def condensed(text: Column, must: Column, must_not: Column) -> Column:
    """All phrases of ``must`` and none of ``must_not`` are present."""
    return F.forall(must, lambda p: has_phrase(text, p)) & ~F.exists(must_not, lambda p: has_phrase(text, p))


def numbered_lines(reply: Column, most: int = 4) -> Column:
    """Lines of a model's list without their numbers, the first ``most``."""
    return F.slice(non_empty(F.transform(F.split(reply, "\n"), lambda x: F.regexp_replace(strip(x), r"^\d+[.)]\s*", ""))), 1, most)


def numbered_choice(reply: Column, n: Column) -> Column:
    """The distinct whole numbers from 1 to ``n`` of a model's list, in order."""
    numbers = F.transform(F.regexp_extract_all(reply, F.lit(r"\d{1,9}"), F.lit(0)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= n)))


def date_range(text: Column) -> Column:
    """(gte, lte) dates of a quarter (``Q3 2024``) or else a year (``2024``) named in a text; null without either."""
    quarter = F.regexp_extract(text, r"(?i)\bQ([1-4])\s+(20\d{2})\b", 1)
    quarter_year = F.regexp_extract(text, r"(?i)\bQ([1-4])\s+(20\d{2})\b", 2)
    year = F.regexp_extract(text, r"\b(20\d{2})\b", 1)
    first = F.make_date(F.try_to_number(quarter_year, F.lit("9999")).cast("int"), ((F.try_to_number(quarter, F.lit("9")).cast("int") - 1) * 3 + 1), F.lit(1))
    of_year = F.try_to_number(year, F.lit("9999")).cast("int")
    return F.when(
        quarter != "", F.struct(first.alias("gte"), F.last_day(F.add_months(first, 2)).alias("lte"))
    ).when(year != "", F.struct(F.make_date(of_year, F.lit(1), F.lit(1)).alias("gte"), F.make_date(of_year, F.lit(12), F.lit(31)).alias("lte")))


def json_object(reply: Column, schema: str) -> Column:
    """A model's JSON reply: as it is, else its outermost braces, else null."""
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    strict = F.when(F.trim(reply).rlike(r"(?s)^\{.*\}$"), F.from_json(F.trim(reply), schema))
    return F.coalesce(strict, F.when(inner != "", F.from_json(inner, schema)))


def preference_reply(reply: Column) -> Column:
    """(action, preference, mode) of ``NULL``, ``CLEAR`` or ``preference|REDO or QUERY``."""
    said = F.trim(reply)
    bar = F.instr(said, "|") > 0
    tail = F.upper(F.trim(F.substring_index(said, "|", -1)))
    action = F.when((said == "") | (F.upper(said) == "NULL"), "none").when(F.upper(said) == "CLEAR", "clear").otherwise("set")
    return F.struct(
        action.alias("action"),
        F.when(action == "set", F.when(bar, F.trim(F.substring_index(said, "|", 1))).otherwise(said)).alias("preference"),
        F.when(action == "set", F.when(bar & tail.isin("REDO", "QUERY"), tail).otherwise("QUERY")).alias("mode"),
    )


def version_of(name: Column, fallback: Column) -> Column:
    """``v1.2`` or else a date in a file name without its ending, else the fallback."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    found = [F.nullif(F.regexp_extract(stem, p, 0), F.lit("")) for p in (r"(?i)v\d+(?:\.\d+)+", r"\d{4}-\d{2}-\d{2}")]
    return F.coalesce(*found, fallback)


def namespace_slug(namespace: Column) -> Column:
    return F.substring(F.sha2(namespace, 256), 1, 8)


def file_slug(namespace: Column) -> Column:
    return F.regexp_replace(namespace, r"[^\w\-]", "_")


def first_sentences(text: Column, n: int = 3) -> Column:
    """Extractive compression: the first sentences."""
    return F.array_join(F.slice(sentences(text), 1, n), " ")


def title_of(text: Column) -> Column:
    """First sentence, at most 80 characters."""
    return F.substring(F.substring_index(text, ".", 1), 1, 80)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 (with or without a byte-order mark), else Windows-1252, whose undefined bytes are Latin-1's."""
    high = [(chr(i), bytes([i]).decode("cp1252", errors="ignore")) for i in range(0x80, 0xA0)]
    high = [(a, b) for a, b in high if b]
    latin = F.translate(F.decode(content, "iso-8859-1"), "".join(a for a, _ in high), "".join(b for _, b in high))
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), latin), "^\ufeff", "")


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """Share of keywords in the answer, case-insensitive; 1 without keywords."""
    hits = F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))))
    return F.when(F.size(keywords) == 0, F.lit(1.0)).otherwise(hits / F.size(keywords))


def scalar_payload(fields: Column) -> Column:
    """A map of JSON texts cut to its strings, numbers and booleans; lists, objects and nulls go."""
    return F.map_filter(fields, lambda k, v: v.isNotNull() & ~F.ltrim(v).rlike(r"^(?:[\[{]|null$)"))


def assembled_prompt(items: Column, conflict: Column | None = None) -> Column:
    """The context items (chunk_id, source_name, ingestion_ts, text) under headers, parted by rules."""
    unknown = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    parts = F.transform(
        items,
        lambda x: F.concat(
            F.lit("[chunk_id: "), unknown(x["chunk_id"]), F.lit("] [source: "), unknown(x["source_name"]),
            F.lit("] [date: "), unknown(x["ingestion_ts"]), F.lit("]\n"), F.coalesce(x["text"], F.lit("")),
        ),
    )
    joined = F.array_join(parts, "\n\n---\n\n")
    return joined if conflict is None else F.concat(joined, F.when(conflict, F.lit("\n\nThe sources disagree; say so.")).otherwise(""))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
