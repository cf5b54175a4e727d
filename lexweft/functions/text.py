"""Text functions as column expressions: normalising, variants, tokens, abbreviations' look, context windows."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: Column | str) -> Column:
    """Runs of white space as one space, trimmed; Unicode spaces count."""
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def greek_to_latin(x: Column | str) -> Column:
    """Greek letters spelled out. Texts without any skip the replacements."""
    x = col(x)
    spelled = functools.reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), fixed.GREEK.items(), x)
    return F.when(x.rlike("[Α-ω]"), spelled).otherwise(x)


def roman_to_arabic(x: Column | str) -> Column:
    """Standalone numerals I to XII as digits."""
    longest = sorted(fixed.ROMAN, key=lambda r: (-len(r), r))
    return functools.reduce(lambda c, r: F.regexp_replace(c, rf"(?U)\b{r}\b", fixed.ROMAN[r]), longest, col(x))


def strip_parenthetical(x: Column | str) -> Column:
    """Without a trailing parenthesis of 1 to 20 characters; the text itself if nothing else is left."""
    bare = F.trim(F.regexp_replace(col(x), r"(?U)\s*\([^)]{1,20}\)\s*$", ""))
    return F.when(bare == "", col(x)).otherwise(bare)


def remove_possessive(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"(?U)'s\b", "")


def normalise(x: Column | str) -> Column:
    """One search form: Greek, parenthesis, possessive, white space."""
    return collapse(remove_possessive(strip_parenthetical(greek_to_latin(x))))


def variants(x: Column | str) -> Column:
    """Search forms in order, the text first; each is derived from the text itself; distinct and not empty."""
    x = col(x)
    low = F.lower(F.trim(x))
    plural = (F.length(low) > 3) & low.endswith("s") & ~low.rlike("(ss|is|us)$")
    forms = [
        x,
        greek_to_latin(x),
        remove_possessive(x),
        strip_parenthetical(x),
        F.when(x.contains("-"), F.replace(x, F.lit("-"), F.lit(""))),
        F.when(x.contains("-"), F.replace(x, F.lit("-"), F.lit(" "))),
        F.when(plural, F.substr(x, F.lit(1), F.length(x) - 1)),
        roman_to_arabic(x),
    ]
    clean = F.transform(F.filter(F.array(*forms), lambda v: v.isNotNull()), collapse)
    return F.array_distinct(F.filter(clean, lambda v: v != ""))


def label_tokens(x: Column | str, least: int = 2) -> Column:
    """Runs of lower-case ASCII letters and digits of ``least`` characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(col(x)), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= least)


def content_tokens(x: Column | str) -> Column:
    """Distinct tokens of three characters and more without stopwords, for overlaps."""
    return F.array_distinct(F.filter(label_tokens(x, 3), lambda t: ~t.isin(fixed.STOPWORDS)))


def significant_words(x: Column | str) -> Column:
    """Lower-case words of a mention of three characters and more without stopwords, in order, repeats kept."""
    return F.filter(F.split(F.lower(F.trim(col(x))), r"(?U)\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(fixed.MENTION_STOPWORDS))


def likely_abbreviation(x: Column | str, least: int = 2, most: int = 10) -> Column:
    """Whether a text looks like an abbreviation: its length, half of it capitals, or (from five characters) a digit."""
    x = F.trim(col(x))
    n = F.length(x)
    half = F.length(F.regexp_replace(x, r"[^\p{Lu}]", "")) / n >= 0.5
    return F.coalesce(n.between(least, most) & ~F.lower(x).isin(fixed.COMMON_SHORT) & (half | ((n > 4) & x.rlike(r"(?U)\d"))), F.lit(False))


def strip_thinking(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"(?s)<think>.*?</think>", ""))


def choice(answer: Column | str, n: Column | int) -> Column:
    """The candidate number in a model's answer, in 1 .. n, or null.

    NONE alone is null. Else the last line's number, if it is in range; else the last number of the whole answer.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(strip_thinking(answer), r"(?U)^\s+", ""), r"(?U)\s+$", ""))
    n = F.lit(n) if isinstance(n, int) else n
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda s: s != "")
    number = lambda s: F.regexp_extract(s, r"\b(\d{1,9})\b", 1).try_cast("int")
    ok = lambda v: F.when((v >= 1) & (v <= n), v)
    first = ok(number(F.try_element_at(lines, F.lit(-1))))
    last = ok(F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b(\d{1,9})\b"), F.lit(1)), F.lit(-1)).try_cast("int"))
    return F.when(F.upper(text) == "NONE", None).otherwise(F.coalesce(first, last))


def sentences(x: Column | str) -> Column:
    return F.split(F.trim(col(x)), r"(?<=[.!?])\s+")


def _highlight(text: Column, mention: Column) -> Column:
    at = F.instr(F.lower(text), F.lower(mention))
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit("**"), F.substr(text, at, F.length(mention)), F.lit("**"), F.substr(text, at + F.length(mention)))).otherwise(text)


def mention_window(context: Column | str, mention: Column | str, around: int = 2) -> Column:
    """The first sentence with the mention, ``around`` sentences on both sides, the mention between asterisks.

    Without such a sentence, the whole context.
    """
    context, mention = col(context), col(mention)
    s = sentences(context)
    # the split stands outside of the lambda, which would repeat it for each sentence
    at = F.array_position(F.transform(s, lambda x: F.contains(F.lower(x), F.lower(mention))), F.lit(True)).cast("int")
    at = F.when(at > 0, at)
    start = F.greatest(at - around, F.lit(1))
    window = F.array_join(F.slice(s, start, at + around - start + 1), " ")
    return F.when(at.isNull(), _replace_first(context, mention)).otherwise(_highlight(window, mention))


def _replace_first(text: Column, mention: Column) -> Column:
    at = F.instr(text, mention)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit("**"), mention, F.lit("**"), F.substr(text, at + F.length(mention)))).otherwise(text)


def sentence_snippet(text: Column | str, mention: Column | str, window: int = 200) -> Column:
    """Characters around the first mention, half a window a side, trimmed at sentence ends in the outer thirds."""
    text, mention = col(text), col(mention)
    pos = F.instr(F.lower(text), F.lower(mention))  # from 1; 0 for none
    start = F.greatest(pos - 1 - window // 2, F.lit(0))
    stop = F.least(F.length(text), pos - 1 + F.length(mention) + window // 2)
    cut = F.substr(text, start + 1, stop - start)
    first = F.instr(cut, F.lit(". ")) - 1
    cut = F.when((first > 0) & (first < F.floor(F.length(cut) / 3)), F.substr(cut, first + 3)).otherwise(cut)
    last = F.length(cut) - F.instr(F.reverse(cut), F.lit(" .")) - 1
    has = F.instr(cut, F.lit(". ")) > 0
    cut = F.when(has & (last > F.floor(F.length(cut) * 2 / 3)), F.substr(cut, F.lit(1), last + 1)).otherwise(cut)
    return F.when(pos == 0, F.substr(text, F.lit(1), F.lit(window))).otherwise(F.trim(cut))


def offset_snippet(text: Column | str, start: Column | str, end: Column | str, window: int = 200) -> Column:
    """Characters around offsets, ``window`` a side, from the last sentence end before to the first one after.

    The cut after the mention is counted in the untrimmed excerpt, also where the front was trimmed.
    """
    text, start, end = col(text), col(start), col(end)
    lo = F.greatest(start - window, F.lit(0))
    full = F.substr(text, lo + 1, F.least(F.length(text), end + window) - lo)
    off = start - lo
    prefix = F.substr(full, F.lit(1), off)
    last = F.when(F.instr(prefix, F.lit(". ")) > 0, F.length(prefix) - F.instr(F.reverse(prefix), F.lit(" .")) - 1)
    cut = F.when(last.isNotNull(), F.substr(full, last + 3)).otherwise(full)
    tail = off + (end - start)
    first = F.instr(F.substr(cut, tail + 1), F.lit(". ")) - 1
    return F.trim(F.when(first >= 0, F.substr(cut, F.lit(1), tail + first + 1)).otherwise(cut))


def tree_category(tree: Column, names: dict[str, str] = fixed.TREE_CATEGORY) -> Column:
    """Category of a tree number by its first letter; the letter itself if it has none."""
    letter = F.substring(tree, 1, 1)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), letter), letter)


def expansion_prompt(mention: Column | str, context: Column | str, title: Column | str | None = None, around: int = 150) -> Column:
    """Prompt that asks for the long form of an abbreviation, with the context around its first place."""
    mention, context = col(mention), col(context)
    pos = F.instr(F.lower(context), F.lower(mention))
    start, stop = F.greatest(pos - 1 - around, F.lit(0)), F.least(F.length(context), pos - 1 + F.length(mention) + around)
    near = F.concat(F.when(start > 0, F.lit("...")).otherwise(""), F.trim(F.substr(context, start + 1, stop - start)), F.when(stop < F.length(context), F.lit("...")).otherwise(""))
    snippet = F.when(pos > 0, near).otherwise(F.concat(F.substr(context, F.lit(1), F.lit(2 * around)), F.lit("...")))
    parts = [F.lit("/no_think"), F.lit("")]
    if title is not None:
        parts.append(F.when(F.coalesce(col(title), F.lit("")) != "", F.concat(F.lit("Title: "), col(title))))
    parts += [F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Context: "), snippet)), F.concat(F.lit("Abbreviation: "), mention)]
    return F.concat_ws("\n", *parts)
