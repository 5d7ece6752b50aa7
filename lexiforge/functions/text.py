"""Scalar text functions (column in, column out), all JVM-side.

Reserved vocabulary entries are fixed values: they must be equal to the
reference's file order for encoded data to be interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiforge.functions.arrays import let

# Reserved token strings and their ids (file order).
PAD, EOS, GO, UNK, OOD = "<_PAD>", "<_EOS>", "<_GO>", "<_UNK>", "<_OOD>"
RESERVED_TOKENS = [PAD, EOS, GO, UNK, OOD]
PAD_ID, EOS_ID, GO_ID, UNK_ID, OOD_ID = 0, 1, 2, 3, 4
RESERVED_LABELS = [UNK]

# Character classes replaced by the cleaner: all but CJK ideographs, ASCII letters and digits, or all but letters and digits.
CJK_CLASS = "[^\\u4e00-\\u9fa5A-Za-z0-9]"
LETTER_CLASS = "[^\\p{L}0-9]"
SENTENCE_MARKS = "[.!?\\n]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(text, char_class: str = LETTER_CLASS) -> Column:
    """Every character outside the class becomes one space (no collapsing)."""
    return F.regexp_replace(_c(text), char_class, " ")


def lower_tokens(tokens) -> Column:
    """P2."""
    return F.transform(_c(tokens), lambda t: F.lower(t))


def word_tokens(text) -> Column:
    """Split on whitespace, drop empty pieces."""
    return F.filter(F.split(_c(text), "\\s"), lambda t: t != F.lit(""))


def char_tokens(text) -> Column:
    """Drop whitespace, one token per character."""
    stripped = F.regexp_replace(_c(text), "\\s", "")
    return F.filter(F.split(stripped, ""), lambda t: t != F.lit(""))


def normalise_tokens(text, char_class: str = LETTER_CLASS) -> Column:
    """P1 + P2 + P3: clean, lower-case, split.  A run of characters outside the
    class becomes one space, which gives the same tokens with fewer pieces; the
    library's own classes leave no other white space."""
    own = char_class in (LETTER_CLASS, CJK_CLASS)
    cleaned = F.lower(F.regexp_replace(_c(text), f"{char_class}+" if own else char_class, " "))
    marks = " " if own else "\\s"
    return F.filter(F.split(cleaned, marks), lambda t: t != F.lit(""))


def cjk_tokens(text) -> Column:
    """P1 + P4 for Chinese text: an ideograph is a token, a run of ASCII letters and digits is one token."""
    return F.regexp_extract_all(clean_text(text, CJK_CLASS), F.lit("([\\u4e00-\\u9fa5]|[A-Za-z0-9]+)"), F.lit(1))


def drop_stop_words(tokens, stop_words) -> Column:
    """P5 on a row: keep tokens not in ``stop_words`` (an array column)."""
    sw = _c(stop_words)
    return F.filter(_c(tokens), lambda t: ~F.array_contains(sw, t))


def normalise_label(label) -> Column:
    """Lower-case; a label containing 'other' becomes 'other'."""
    low = F.lower(_c(label))
    return F.when(low.contains("other"), F.lit("other")).otherwise(low)


def wrap_tokens(tokens, max_len: int) -> Column:
    """[GO] + tokens[:max_len-2] + [EOS] (callers drop empty token lists)."""
    return F.concat(F.array(F.lit(GO)), F.slice(_c(tokens), 1, max_len - 2), F.array(F.lit(EOS)))


def cut_at_eos(ids, eos_id: int = EOS_ID, compat: bool = False) -> Column:
    """Ids before the first EOS.  Without EOS the whole list is kept; with
    ``compat`` the last id is lost, as a search result of -1 slices it away."""
    ids = _c(ids)
    pos = F.array_position(ids, F.lit(eos_id))
    keep = F.when(pos > 0, pos - 1).otherwise(
        F.size(ids) - 1 if compat else F.size(ids))
    return F.slice(ids, 1, F.greatest(keep, F.lit(0)))


def join_tokens(tokens, sep: str = " ") -> Column:
    """P9."""
    return F.array_join(_c(tokens), sep)


def clean_generated(text, compat: bool = False) -> Column:
    """P10: drop spaces and <_UNK>, then drop every character equal to the one
    before it.  ``compat`` also compares the first character with the last."""
    s = F.replace(F.replace(_c(text), F.lit(" "), F.lit("")), F.lit(UNK), F.lit(""))
    if not compat:
        return F.regexp_replace(s, "(?s)(.)\\1+", "$1")
    chars = F.filter(F.split(s, ""), lambda c: c != F.lit(""))
    kept = F.filter(chars, lambda c, i: c != F.element_at(chars, F.when(i == 0, F.size(chars)).otherwise(i)))
    return F.array_join(kept, "")


def slot_multi_hot(slot_tags, slot_ids_map, n_slots: int) -> Column:
    """Tags after 'b-' become a 0/1 vector over the slot vocabulary."""
    names = F.array_distinct(F.transform(
        F.filter(F.split(_c(slot_tags), " "), lambda t: t.contains("b-")),
        lambda t: F.element_at(F.split(t, "b-"), 2)))
    ids = F.filter(F.transform(names, lambda n: F.try_element_at(_c(slot_ids_map), n)),
                   lambda x: x.isNotNull())
    return F.transform(F.sequence(F.lit(0), F.lit(n_slots - 1)),
                       lambda k: F.when(F.array_contains(ids, k), 1).otherwise(0))


def slot_names(slot_tags) -> Column:
    """The distinct names after 'b-' in an array of lower-cased tags."""
    begins = F.filter(_c(slot_tags), lambda t: t.contains("b-"))
    return F.array_distinct(F.transform(begins, lambda t: F.element_at(F.split(t, "b-"), 2)))


def shape_tags(tokens) -> Column:
    """Slot tags of tokens by their shape: 'b-<kind>' where a run of a kind
    starts, 'i-<kind>' where it goes on, else 'o'.  Kinds: number (digits only),
    code (digits among others), initial (one character)."""
    kind = lambda w: (F.when(w.rlike("^[0-9]+$"), "number").when(w.rlike("[0-9]"), "code")
                      .when(F.length(w) == 1, "initial").otherwise(""))
    tag = lambda k, before: F.when(k == "", "o").when(k == before, F.concat(F.lit("i-"), k)).otherwise(
        F.concat(F.lit("b-"), k))
    return let(F.transform(_c(tokens), kind), lambda kinds: F.zip_with(
        kinds, F.slice(F.concat(F.array(F.lit("")), kinds), 1, F.size(kinds)), tag))


def remove_spaces(text) -> Column:
    """P13."""
    return F.replace(_c(text), F.lit(" "), F.lit(""))


def variant_size(alpha: float, n_tokens) -> Column:
    """max(1, int(alpha * len))."""
    return F.greatest(F.lit(1), F.floor(F.lit(alpha) * _c(n_tokens)).cast("int"))


def per_technique(num_aug: int) -> int:
    """Variants per technique, int(num_aug/4)+1."""
    if not isinstance(num_aug, int) or num_aug < 1:
        raise ValueError("num_aug must be a positive integer")
    return num_aug // 4 + 1
