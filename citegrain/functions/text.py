"""Column functions over questions, answers and Markdown lines. Null reads as the empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS

# Words that turn a question's meaning.
POLARITY = (
    "not no never without except excluding avoid best worst most least cheapest priciest fastest slowest largest smallest highest lowest "
    "more less fewer better worse faster slower pros cons advantages disadvantages benefits drawbacks should shouldn't can can't cannot "
    "isn't aren't before after under over above below"
).split()
# Words that say nothing about a question's topic.
STOPWORDS = (
    "a an the is are was were be been being do does did doing have has had having i me my we our you your it its they them "
    "what which who whom whose when where why how and or but if then than as of at by for with about into to from in on out up down "
    "so that this these those there here get got make made use used using need want please tell explain give show some any all"
).split()
# Beginnings of the canned answers.
FALLBACKS = (
    "I couldn't find reliable sources to answer this question. This can happen with very new, niche, or ambiguous topics — try rephrasing the question or making it more specific.",
    "I encountered an error while generating the answer. Please try again or rephrase your question.",
    "Sorry, I had trouble responding just now. Please try again.",
)
# MIME types by extension.
MIME = {".txt": "text/plain", ".md": "text/plain", ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}

# The patterns of Markdown lines and citation markers.
SEPARATOR = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$"
ROW = r"^\s*\|.*\|\s*$"
HEADING = r"^\s{0,3}#{1,6}\s+"
BULLET = r"^\s*[-*+]\s+\S"
ORDERED = r"^\s*\d+[.)]\s+\S"
FENCE = r"^\s*```"
MARKER = r"\[(\d+)\]"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words_array(words: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def norm_question(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), r"(?U)\s+", " "))


def url_domain(c: Column) -> Column:
    return F.replace(F.try_parse_url(c, F.lit("AUTHORITY")), F.lit("www."), F.lit(""))


def safe_url(c: Column, fallback: str = "") -> Column:
    return F.when(F.trim(c).rlike(r"(?i)^https?://"), F.trim(c)).otherwise(F.lit(fallback))


def numbers_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"(\d+(?:\.\d+)*)"), 1))


def words_in(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit(r"([a-z0-9']+)"), 1)


def content_words(c: Column) -> Column:
    informative = F.filter(words_in(c), lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$"))
    return F.array_except(informative, words_array(STOPWORDS))


def polarity_words(c: Column) -> Column:
    return F.array_intersect(words_in(c), words_array(POLARITY))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of content words; 0 where a side has none."""
    x, y = content_words(a), content_words(b)
    both = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both).otherwise(0.0)


def sym_diff(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def comparison_order(c: Column) -> Column:
    """The two words around the first inner 'vs' or 'versus', or null."""

    def around(w: Column) -> Column:
        inner = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i > 1) & (i < F.size(w)) & F.get(w, i - 1).isin("vs", "versus"))
        i = F.get(inner, F.lit(0))
        return F.when((F.size(w) > 0) & i.isNotNull(), F.concat_ws(" ", F.get(w, i - 2), F.get(w, i)))

    return F.get(F.transform(F.array(words_in(c)), around), F.lit(0))  # bound by a lambda, the words are taken once


def question_traits(c: Column) -> Column:
    """What `rejection_reason` compares, as a struct of texts: alike (numbers and polarity words; null for a blank question), compared
    (the order of a comparison, or null) and words (content words, joined by blanks, of which none holds one)."""
    told = lambda a: F.array_join(F.array_sort(a), " ")
    alike = F.when(F.trim(text(c)) != "", F.concat(told(numbers_in(c)), F.lit("|"), told(polarity_words(c))))
    return F.struct(alike.alias("alike"), comparison_order(c).alias("compared"), F.array_join(content_words(c), " ").alias("words"))


def rejection_reason(query: Column, candidate: Column, min_overlap: float = DEFAULTS.word_overlap) -> Column:
    """Why an answer to `candidate` must not serve `query`; null: it may."""
    numbers = sym_diff(numbers_in(query), numbers_in(candidate))
    polarity = sym_diff(polarity_words(query), polarity_words(candidate))
    overlap = token_overlap(query, candidate)
    blank = (F.trim(text(query)) == "") | (F.trim(text(candidate)) == "")
    told = lambda head, items: F.concat(F.lit(head + " ("), F.array_join(items, ", "), F.lit(")"))
    # fixed values: the messages
    return (
        F.when(blank, "empty question")
        .when(F.size(numbers) > 0, told("different numbers", numbers))
        .when(F.size(polarity) > 0, told("different polarity", polarity))
        .when(comparison_order(query) != comparison_order(candidate), "comparison asked in the opposite order")
        .when(overlap < min_overlap, F.format_string(f"low word overlap (%.2f < {min_overlap:.2f})", overlap))
    )


def citation_markers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(text(c), F.lit(MARKER), 1), lambda x: x.try_cast("int"))


def claim_context(answer: Column, n: Column) -> Column:
    """The sentence around the first [n], without markers, of 300 characters at most; empty if [n] isn't there."""
    t, mark = text(answer), F.concat(F.lit("["), n.cast("string"), F.lit("]"))
    pos = F.instr(t, mark) - 1  # 0-based
    low = F.greatest(pos - 299, F.lit(0))
    before = F.substr(t, low + 1, F.greatest(pos - 2 - low, F.lit(0)))
    upto = F.length(F.regexp_extract(before, r"(?s)^.*[.!?\n]", 0))
    start = F.when(upto > 0, low + upto).otherwise(F.greatest(pos - 150, F.lit(0)))
    behind = pos + F.length(mark)
    ahead = F.length(F.regexp_extract(F.substr(t, behind + 1, F.lit(300)), r"(?s)^[^.!?\n]*[.!?\n]", 0))
    end = F.when(ahead > 0, behind + ahead).otherwise(F.least(F.length(t), pos + 200))
    told = F.trim(F.regexp_replace(F.substr(t, start + 1, F.greatest(end - start, F.lit(0))), r"\[\d+\]", ""))
    return F.when(pos >= 0, F.substring(told, 1, 300)).otherwise("")


def lines(c: Column) -> Column:
    """Lines of a text; a last empty one doesn't count."""
    parts = F.split(text(c), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_class(line: Column) -> Column:
    return (
        F.when(F.trim(line) == "", "blank").when(line.rlike(HEADING), "heading").when(line.rlike(SEPARATOR), "separator")
        .when(line.rlike(ROW), "row").when(line.rlike(BULLET) | line.rlike(ORDERED), "item").otherwise("prose")
    )


def split_sentences(c: Column) -> Column:
    return F.split(text(c), r"(?<=[.!?])\s+(?=[A-Z0-9\"'\[])")


def clean_list(c: Column, most: int) -> Column:
    """Trimmed entries that aren't blank, `most` at most."""
    return F.slice(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), 1, most)


def clean_sub_queries(c: Column, query: Column, most: int = DEFAULTS.max_sub_queries) -> Column:
    """Trimmed, distinct whatever the case (the first stays), `most` at most; the query joins where fewer than two are left."""
    kept = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    lowered = F.transform(kept, lambda x: F.lower(x))
    first = F.slice(F.filter(kept, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1), 1, most)
    seen = F.array_contains(F.transform(first, lambda x: F.lower(x)), F.lower(F.trim(query)))
    return F.when(c.isNull(), F.array(query)).otherwise(F.when((F.size(first) < 2) & ~seen, F.concat(first, F.array(query))).otherwise(first))


def salvage_json(c: Column) -> Column:
    """The text if it is JSON, else its outermost braces if they are, else null."""
    braces = F.regexp_extract(text(c), r"(?s)\{.*\}", 0)
    ok = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(ok(c), c).when((braces != "") & ok(braces), braces)


def strip_control(c: Column, name: bool = False) -> Column:
    return F.substring(F.regexp_replace(text(c), r"[\x00-\x1f\x7f]", ""), 1, 50) if name else F.regexp_replace(text(c), r"[\x00-\x08\x0b-\x1f\x7f]", "")


def mime_for_filename(c: Column) -> Column:
    ext = F.lower(F.regexp_extract(text(c), r"[^/](\.[^./]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])[ext], F.lit("application/octet-stream"))


def safe_filename(c: Column) -> Column:
    kept = F.regexp_replace(text(c), r'[\r\n"\\]', "")
    return F.when(F.trim(kept) == "", "file").otherwise(kept)


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), "^-|-$", "")
    cut = F.substring(dashed, 1, 60)
    return F.when(cut == "", "session").otherwise(cut)


def clean_inline(c: Column) -> Column:
    """Text without bold, italic, code, link and citation marks."""
    for pattern, to in ((r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\[\d+\]", "")):
        c = F.regexp_replace(c, pattern, to)
    return c


def preview(c: Column, most: int = DEFAULTS.preview_chars) -> Column:
    flat = F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def preview_col(c: Column, most: int, capture: bool = True) -> Column:
    """Null where capture is off; else the first characters and how many were cut."""
    if not capture:
        return F.lit(None).cast("string")
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("… [+"), F.length(c) - most, F.lit(" chars]"))).otherwise(c)


def favicon_url(url: Column, domain: Column) -> Column:
    return F.when(url.startswith("file://"), "").otherwise(F.concat(F.lit("https://www.google.com/s2/favicons?domain="), domain, F.lit("&sz=32")))


def force_split(c: Column, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> Column:
    """Slices of `size` characters at a fixed stride."""
    stride = max(1, size - overlap)
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c), F.lit(stride)), lambda i: F.substr(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
