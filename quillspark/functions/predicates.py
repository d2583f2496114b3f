"""Predicates and routings over text and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import any_of, strip

# fixed values: openings of answers that say nothing, and marks of non-answers
UNANSWERED_PREFIXES = ("i'm sorry", "i was unable", "an internal error", "i cannot answer", "i could not find")
NON_ANSWER_MARKS = (
    "i cannot answer this from the available context",
    "i've handed off your question to another agent",
    "i don't know",
    "i do not know",
)

# fixed values: messages that clear preferences, that are small talk, and that open a question
CLEARING = r"(?i)\b(?:forget (?:everything|all|all preferences)|reset (?:your |all )?(?:instructions?|preferences?|settings?)|start fresh|clear (?:your |all )?(?:memory|preferences?|instructions?)|ignore all (?:previous |prior )?preferences?)\b"
SMALL_TALK = r"(?i)^(?:ok|okay|thanks?|thank you|cool|great|nice|sure|interesting|got it|i see|makes sense|sounds good|no problem|hello|hi|hey|good|alright|perfect|wonderful|awesome)\s*[.!?]?$"
QUESTION_OPENING = r"(?i)^(?:what|who|why|how|when|where|which|is |are |does |do |can |could |would |should |explain |describe |tell me |show |find |list |give |help |summarize |summarise |compare )"


def unanswered(answer: Column, faithfulness: Column, least: float = 0.3) -> Column:
    """Empty, opening like a refusal, or of a faithfulness below ``least``."""
    text = F.lower(strip(F.coalesce(answer, F.lit(""))))
    return (F.coalesce(answer, F.lit("")) == "") | any_of([text.startswith(p) for p in UNANSWERED_PREFIXES]) | F.coalesce(faithfulness < least, F.lit(False))


def non_answer(answer: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return any_of([text.contains(m) for m in NON_ANSWER_MARKS])


def detectable(text: Column, least: int = 20) -> Column:
    """Whether a text is long enough for language detection."""
    return F.length(F.trim(text)) >= least


def violations(latency_ms: Column, cost: Column, tokens: Column, p99_ms=10_000, max_cost=0.05, max_tokens=6000, enabled=True) -> Column:
    """Names of the service levels missed; a limit of None checks nothing."""
    checks = [("latency", latency_ms, p99_ms), ("cost", cost, max_cost), ("tokens", tokens, max_tokens)]
    found = [F.when(value > limit, F.lit(name)) for name, value, limit in checks if enabled and limit is not None]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def answer_flags(answer: Column, faithfulness: Column, least=0.40, shortest=20, longest=8000) -> Column:
    """Guardrail findings of an answer: low faithfulness, too few or too many characters."""
    n = F.length(answer)
    return F.array_compact(F.array(
        F.when(faithfulness < least, "faithfulness"), F.when(n < shortest, "too_short"), F.when(n > longest, "too_long"),
    ))


def pii_flag(text: Column, redacted: Column, blocking: bool) -> Column:
    """``none``, ``found`` or ``blocked``."""
    return F.when(text == redacted, "none").otherwise("blocked" if blocking else "found")


def embedding_model(source_name: Column, language: Column, domains: list[tuple[str, str]], multilingual: str, default: str) -> Column:
    """The first domain whose key the source's name holds, else by language, else the default."""
    out = None
    for key, model in domains:
        test = F.contains(F.lower(source_name), F.lit(key.lower()))
        out = F.when(test, model) if out is None else out.when(test, model)
    other = F.when(F.coalesce(language, F.lit("en")) != "en", multilingual).otherwise(default)
    return other if out is None else out.otherwise(other)


def preference_kind(message: Column) -> Column:
    """Fast classification of a message: ``clear``, ``null`` or undecided (null)."""
    text = F.trim(message)
    words = F.size(F.split(text, r"\s+"))
    clear, nothing = text.rlike(CLEARING), text.rlike(SMALL_TALK)
    question = (words >= 5) & text.rlike(QUESTION_OPENING)
    return F.when(clear, "clear").when(nothing | question, "null")


def wants_hypothesis(query: Column, least: int = 5) -> Column:
    """Queries of fewer words skip the hypothetical document."""
    return F.size(F.split(F.trim(query), r"\s+")) >= least


def fast_model(n_items: Column, most: int = 2) -> Column:
    return F.when(n_items <= most, "fast").otherwise("full")


def sampled(key: Column, rate: float = 0.05) -> Column:
    """Deterministic sampling by a key's hash."""
    return F.pmod(F.xxhash64(key), F.lit(10_000)) < int(rate * 10_000)


def in_namespace(namespace: str | None, column: str = "namespace") -> Column:
    """Rows of the namespace; all rows where it is None or ``default``."""
    return F.lit(True) if namespace in (None, "default") else F.col(column) == namespace


def searchable(namespace: str | None = None, level: str | None = "paragraph", **metadata) -> Column:
    """What a search may return: the level, the namespace and equal metadata columns; None restricts nothing."""
    test = in_namespace(namespace)
    if level is not None:
        test = test & (F.col("level") == level)
    for name, value in metadata.items():
        test = test & (F.col(name) == value)
    return test


def extractable(modality: Column, text: Column) -> Column:
    """Whether a chunk's entities can be extracted: plain text that is not empty."""
    return (modality == "text") & (F.trim(F.coalesce(text, F.lit(""))) != "")
