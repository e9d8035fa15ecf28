"""Scalar functions on text, hashes and numbers: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_of(col: Column | str) -> Column:
    return F.coalesce(_c(col), F.lit(""))


def normalize_ws(col: Column | str) -> Column:
    """Delete control characters, collapse white space to one space, trim.

    Most texts need the trim only; a look at plain ranges tells, which costs a fraction of the two replacements.
    """
    text = F.trim(text_of(col))
    kept = F.regexp_replace(text, f"[{X.CONTROL}]", "")
    done = F.trim(F.regexp_replace(kept, f"[{X.WS}]+", " "))
    return F.when(text.rlike(X.NOT_PLAIN) | text.contains("  "), done).otherwise(text)


def remove_ws(col: Column | str) -> Column:
    return F.regexp_replace(text_of(col), f"[{X.WS}]+", "")


def is_blank(col: Column | str) -> Column:
    return normalize_ws(col) == ""


def text_hash(col: Column | str) -> Column:
    """First 24 hex digits of the SHA-256 of the normalised text."""
    return F.substring(F.sha2(normalize_ws(col), 256), 1, 24)


def strip_soft(col: Column | str) -> Column:
    return F.translate(text_of(col), X.SOFT, "")


def ligatures(col: Column | str) -> Column:
    out = text_of(col)
    for a, b in X.LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def squeeze_cjk(col: Column | str) -> Column:
    """Drop spaces that stand between two CJK characters."""
    return F.regexp_replace(text_of(col), f"(?<=[{X.CJK_EDGE}])[ \\u3000]+(?=[{X.CJK_EDGE}])", "")


def clean_pdf_text(col: Column | str) -> Column:
    return normalize_ws(ligatures(col))


def clean_paragraph(col: Column | str) -> Column:
    return squeeze_cjk(strip_soft(normalize_ws(col)))


def is_cjk(col: Column | str) -> Column:
    return _c(col).rlike(f"^[{X.CJK}]")


def join_wrapped(a: Column, b: Column, vertical: bool = False) -> Column:
    """Join two wrapped lines: glue, undo hyphenation, or put a space between."""
    if vertical:
        return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, b))
    first, last = F.substring(b, 1, 1), F.substring(a, -1, 1)
    lower = (first == F.lower(first)) & (first != F.upper(first))
    return (
        F.when(a == "", b)
        .when(b == "", a)
        .when((F.length(a) > 1) & a.rlike("[-\\u2010\\u2011\\u00ad]$") & lower, F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b))
        .when(is_cjk(last) | is_cjk(first), F.concat(a, b))
        .otherwise(F.concat(a, F.lit(" "), b))
    )


def has_kana(col: Column | str) -> Column:
    return text_of(col).rlike(f"[{X.KANA}]")


def is_untranslated(source: Column | str, target: Column | str, min_chars: int = 0) -> Column:
    """The target equals the source but for white space, and the source has kana."""
    s = remove_ws(source)
    return (s != "") & (s == remove_ws(target)) & (F.length(s) >= min_chars) & has_kana(s)


def classify_matter(path: Column | str, title: Column | str) -> Column:
    path, title = text_of(path), F.trim(text_of(title))
    out = F.lit("main")
    for kind, pattern in reversed(X.MATTER_TITLES):
        out = F.when((title != "") & title.rlike("(?i)" + pattern), kind).otherwise(out)
    for kind, pattern in reversed(X.MATTER_PATHS):
        out = F.when((path != "") & path.rlike("(?i)" + pattern), kind).otherwise(out)
    return out


def slugify(col: Column | str, most: int = 28) -> Column:
    dashed = F.regexp_replace(F.trim(text_of(col)), r"[^0-9A-Za-z぀-ヿ一-鿿]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, most), "-+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("book"))


def is_page_number(col: Column | str) -> Column:
    return F.trim(text_of(col)).rlike(X.PAGE_NUMBER)


def segment_kind(offset: Column, height: Column, lo: float = 0.30, hi: float = 1.80) -> Column:
    return F.when(offset < height * lo, "cont").when(offset < height * hi, "start").otherwise("inner")


def strip_lead(text: Column) -> Column:
    """Text without spaces and dashes at its start."""
    return F.regexp_replace(text, "^[ \\u3000\\u2500\\-\\u2014]+", "")


def strip_title_prefix(text: Column, title: Column) -> Column:
    rest = F.substring(text, F.length(title) + 1, F.length(text))
    return F.when((title != "") & F.startswith(text, title), strip_lead(rest)).otherwise(text)


def tsv_escape(col: Column | str) -> Column:
    out = text_of(col)
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def tsv_unescape(col: Column | str) -> Column:
    """Undo tsv_escape in one pass: a doubled backslash is set aside first, so no letter after it is taken for an escape."""
    mark = "\ue000"
    out = F.replace(text_of(col), F.lit("\\\\"), F.lit(mark))
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(out, F.lit(mark), F.lit("\\"))


def output_stem(title: Column | str, doc_id: Column | str) -> Column:
    """A file name from a title, or the id."""
    kept = F.regexp_replace(F.regexp_replace(text_of(title), "[\\x00-\\x1f]", ""), r"[/\\]", "")
    wide = F.regexp_replace(F.translate(kept, X.STEM_FROM, X.STEM_TO), f"[{X.WS}]+", " ")
    ends = r"^[ .]+|[ .]+$"
    cut = F.regexp_replace(F.substring(F.regexp_replace(wide, ends, ""), 1, X.MAX_STEM), ends, "")
    return F.coalesce(F.nullif(cut, F.lit("")), _c(doc_id).cast("string"))


def mask_secret(col: Column | str) -> Column:
    c = text_of(col)
    return F.when(F.length(c) <= 10, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.substring(c, 1, 6), F.lit("******"), F.substring(c, -4, 4)))


def estimate_tokens(col: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text_of(col)) / 1.5).cast("int"))


def estimate_cost(tokens_in: Column, tokens_out: Column, model: Column, tier: Column) -> Column:
    """Cost by a price table; peak doubles it, local is free, an unknown model counts as the first."""
    miss, out = F.lit(X.PRICES[0][1]), F.lit(X.PRICES[0][2])
    for name, a, b in X.PRICES:
        miss, out = F.when(model == name, a).otherwise(miss), F.when(model == name, b).otherwise(out)
    rate = F.when(tier == "peak", X.PEAK).otherwise(1.0)
    return F.when(tier == "local", 0.0).otherwise(tokens_in / 1e6 * miss * rate + tokens_out / 1e6 * out * rate)


def effective_text(final: Column | str, machine: Column | str) -> Column:
    """The reviewed text, else the machine's, else empty; an empty string counts as missing."""
    return F.coalesce(F.nullif(_c(final), F.lit("")), F.nullif(_c(machine), F.lit("")), F.lit(""))


def traditional_chars(col: Column | str) -> Column:
    """Distinct characters of the text that simplified Chinese does not use."""
    found = F.regexp_extract_all(text_of(col), F.lit(f"[{X.NON_SIMPLIFIED}]"), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def length_ratio(source: Column | str, target: Column | str) -> Column:
    return F.length(remove_ws(target)) / F.nullif(F.length(remove_ws(source)), F.lit(0))


def chapter_budget(budget: Column, window: Column) -> Column:
    return F.greatest(F.lit(80), F.floor(budget / F.greatest(F.lit(1), window)).cast("int"))


def progress_band(progress: Column, lo: float, hi: float) -> Column:
    """A share of done work, mapped into [lo, hi] and clamped."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), progress))
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.lit(lo) + F.lit(hi - lo) * p))


def without_rt(html: Column | str) -> Column:
    """Text of markup without ruby annotations and tags."""
    bare = F.regexp_replace(F.regexp_replace(text_of(html), r"(?is)<rt\b[^>]*>.*?</rt>", ""), r"(?s)<[^>]*>", "")
    return normalize_ws(bare)


def strip_fences(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.trim(text_of(col)), r"(?m)^```[A-Za-z0-9_-]*[ \t]*$", ""), F.lit(" \n\t\r"))


def typeset_escape(col: Column | str) -> Column:
    """Escape markup characters, and list marks at line starts."""
    out = F.regexp_replace(text_of(col), r"([\\#$*_`@<>\[\]~])", r"\\$1")
    return F.regexp_replace(out, r"(?m)^([-+/=])", r"\\$1")


def upper_median(values: Column) -> Column:
    """The middle of an array, the upper one of two; null where it is empty."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))
