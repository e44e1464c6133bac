"""Text rules shared by question making, grading and transcripts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no terms, and the patterns of terms and of characters that don't count.
STOP_WORDS = [
    "一个", "这个", "可以", "就是", "因为", "所以", "如果", "以及", "或者", "通过", "使用", "进行", "实现", "需要", "我们",
    "他们", "它们", "这些", "那些", "什么", "以下", "上述", "例如", "比如", "注意", "但是", "而且", "并且", "用于", "属于",
]
TERM = r"[A-Za-z][A-Za-z0-9+#.\-]{1,17}|[一-鿿]{2,10}"
KEYWORD = r"[A-Za-z][A-Za-z0-9+#.\-]{1,17}|[一-鿿]{2,12}"
UNCOUNTED = r"[\s，。、；：！？,.;:!?（）()【】\[\]\"'`*#>_-]"
WIDE = r"[一-鿿　-〿＀-￯]"
HAN = r"[一-鿿]"


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def terms(text: Column, limit: int) -> Column:
    """The first ``limit`` distinct terms of a text, in order, without stop words."""
    return F.slice(F.array_except(F.array_distinct(all_matches(text, TERM)), F.array(*map(F.lit, STOP_WORDS))), 1, limit)


def bare(text: Column) -> Column:
    """Lower-cased text without blanks and punctuation; null counts as empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), UNCOUNTED, ""))


def choice_letters(text: Column) -> Column:
    """Distinct letters of a choice in order; a text without any falls back to the bare text."""
    letters = F.array_join(F.array_sort(F.array_distinct(all_matches(F.upper(F.coalesce(text, F.lit(""))), "[A-Z]"))), "")
    return F.when(letters != "", letters).otherwise(bare(text))


def count_of(text: Column, pattern: str) -> Column:
    """Number of characters that match a one-character pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def estimate_tokens(text: Column) -> Column:
    """Wide characters count one each, four others count one, at least one; empty is 0."""
    text = F.coalesce(text, F.lit(""))
    wide = count_of(text, WIDE)
    return F.when(text == "", 0).otherwise(wide + F.greatest(F.lit(1), F.floor((F.length(text) - wide) / 4))).cast("int")


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """``text`` with the first occurrence of ``old`` replaced; unchanged without one."""
    at = F.position(old, text)
    return F.when((at > 0) & (F.length(old) > 0), F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)
