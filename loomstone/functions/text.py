"""Text functions as column expressions; patterns are written so that other engines' dialects agree on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layout and boilerplate words without topical meaning, and terms that stay although they look like them.
STOPWORDS = (
    "page pages table tables annexure annexures figure figures plate plates drawing drawings dated date ref reference no vide etc "
    "herein thereof whereas abovementioned aforesaid hereby sno sl sr total subtotal nil na n/a yes applicable enclosed attached "
    "annexed duly undersigned signature seal stamp chapter para paragraph item serial sheet volume part section_header"
).split()
PRESERVED = (
    "rule section act regulation clause sub-section sub-rule cmr mmdr mcr epa fca ec fc cte cto om statutory appendix guidelines "
    "form schedule compliance qp"
).split()


def words(text: Column) -> Column:
    """Maximal runs of letters, marks, digits, _ and - of the lower-cased text."""
    return F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}_\-]+")


def tokens(text: Column) -> Column:
    """Topic tokens: ASCII words, outer - and _ trimmed, at least two characters, not all digits."""
    plain = F.filter(words(text), lambda w: w.rlike(r"^[a-z0-9_\-]+$"))
    cut = F.transform(plain, lambda w: F.btrim(w, F.lit("-_")))
    return F.filter(cut, lambda w: (F.length(w) >= 2) & w.rlike("[^0-9]"))


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_query(text: Column) -> Column:
    """Leading question words dropped, other signs than - . / to spaces, squeezed; the text itself if nothing is left."""
    lead = F.regexp_replace(F.trim(text), r"(?i)^(what\s+was|what\s+is|what\s+are|compare|tell\s+me\s+about|find|search\s+for|show\s+me)\s+", "")
    clean = squeeze(F.regexp_replace(lead, r"[^\p{L}\p{M}\p{N}_\s\-./]", " "))
    return F.when(clean == "", F.trim(text)).otherwise(clean)


def clean_corpus(text: Column) -> Column:
    """Typographic quotes and dashes to ASCII, divider runs dropped, squeezed, stop words dropped unless preserved."""
    s = F.regexp_replace(text, r"[~^|\\]+|[-_=]{3,}", " ")
    s = F.translate(s, "–—‘’“” ", "--''\"\" ")
    drop = sorted(set(STOPWORDS) - set(PRESERVED))
    kept = F.filter(F.split(squeeze(s), " "), lambda w: ~F.regexp_replace(F.lower(w), r"^[.,;:()\[\]{}']+|[.,;:()\[\]{}']+$", "").isin(*drop))
    return F.array_join(kept, " ")


def reduction(before: Column, after: Column) -> Column:
    """Share of characters that cleaning removed."""
    return F.when(F.length(before) > 0, F.round((F.length(before) - F.length(after)) / F.length(before), 4)).otherwise(0.0)


def sentences(text: Column) -> Column:
    """Sentences of more than 8 characters, list marks removed."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), r"\n+")
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.trim(s), r"^(?:\d+\.|\*|-)\s*", "")))
    return F.filter(clean, lambda s: F.length(s) > 8)


def numbers(text: Column) -> Column:
    """Number tokens, without one-digit citation marks such as [1]."""
    found = F.regexp_extract_all(text, F.lit(r"\b\d+(?:\.\d+)?%?"), F.lit(0))
    return F.filter(found, lambda n: ~((F.length(n) == 1) & F.contains(text, F.concat(F.lit("["), n, F.lit("]")))))


def occurrences(text: Column, term: Column | str) -> Column:
    """Non-overlapping occurrences of a lower-case term in the lower-cased text."""
    t = F.lit(term) if isinstance(term, str) else term
    low = F.lower(F.coalesce(text, F.lit("")))
    return ((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("int")


def snippet(text: Column, start: Column, length: Column, around: int = 40) -> Column:
    """The match at 1-based ``start`` with ``around`` characters on both sides, line ends as spaces."""
    begin = F.greatest(F.lit(1), start - around)
    return F.trim(F.replace(F.substring(text, begin, start + length + around - begin), F.lit("\n"), F.lit(" ")))


def topic_label(terms: Column) -> Column:
    """A label of the first four terms."""
    first = F.transform(F.slice(terms, 1, 4), lambda t: F.initcap(F.translate(t, "_-", "  ")))
    return F.when(F.size(terms) == 0, F.lit("Uncategorised")).otherwise(F.array_join(first, " / "))


def stem_tokens(filename: Column) -> Column:
    """Lower-case tokens of a file name without its extension."""
    return F.filter(F.split(F.regexp_replace(F.lower(filename), r"\.[a-z0-9]+$", ""), r"[^a-z0-9]+"), lambda w: w != "")


def redact(text: Column, most: int = 1024) -> Column:
    """Bearer tokens, JWTs and secret assignments masked; a longer text is cut and says by how much."""
    s = F.regexp_replace(text, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED_JWT]")
    s = F.regexp_replace(s, r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]")
    s = F.regexp_replace(s, r"(?i)(password|passwd|secret|token|api_key|apikey)(\s*[=:]\s*)\S+", "$1$2[REDACTED]")
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.format_string("...[truncated %d chars]", F.length(s) - most))).otherwise(s)


def document_type(filename: Column) -> Column:
    """A document type from words of the file name, first match."""
    low = F.lower(filename)
    return (
        F.when(low.rlike("closure"), "CLOSURE_PLAN")
        .when(low.rlike("mining|mine.?plan"), "MINING_PLAN")
        .when(low.rlike("geolog|borehole"), "GEOLOGICAL_REPORT")
        .when(low.rlike("production|monthly"), "PRODUCTION_REPORT")
        .when(low.rlike("safety|accident"), "SAFETY_REPORT")
        .otherwise("OTHER")
    )


MIME_LABELS = {
    "application/pdf": "PDF",
    "text/csv": "CSV",
    "text/plain": "Text",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "Word",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "Excel",
    "application/vnd.ms-excel": "Excel (legacy)",
    "image/png": "Image",
    "image/jpeg": "Image",
}


def mime_label(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, mime), F.lit("Other"))


def safe_url(url: Column) -> Column:
    """struct<ok, reason, clean>: scheme and host checks; credentials never leave."""
    scheme, host, user = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST"))), F.try_parse_url(url, F.lit("USERINFO"))
    reason = (
        F.when(scheme.isNull() | ~scheme.isin("http", "https"), "bad scheme")
        .when(host.isNull() | (host == ""), "no host")
        .when(host.isin("localhost", "metadata.google.internal", "169.254.169.254") | host.rlike(r"^127\.|^0\.0\.0\.0$|^\[?::1"), "denied host")
        .when(user.isNotNull(), "embedded credentials")
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"), F.regexp_replace(url, r"://[^/@]*@", "://").alias("clean"))
