"""Column expressions on text that several operators use."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.frames import bound

Text = Column | str


def _col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def numbers(text: Text) -> Column:
    """All numbers of a text, thousands commas dropped."""
    return F.transform(F.regexp_extract_all(F.replace(_col(text), F.lit(","), F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def first_number(text: Text) -> Column:
    return F.try_element_at(numbers(text), F.lit(1))


def normalised(text: Text) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", " "))


def tokens(text: Text, least: int = 1) -> Column:
    """Distinct a-z0-9 words of at least `least` letters."""
    return F.array_distinct(F.filter(F.split(normalised(text), " "), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two arrays of distinct items; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def upper_trimmed(text: Text) -> Column:
    """Upper case and trimmed; null is empty."""
    return F.upper(F.trim(F.coalesce(_col(text), F.lit(""))))


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whether a lower-cased text holds any of the phrases; null holds none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def labels_in(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Distinct labels, in the order of pairs, of the phrases that a lower-cased text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(label)) for p, label in pairs])))


def percentage(text: Text) -> Column:
    """The first percentage of a text."""
    return F.regexp_extract(_col(text), r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double")


class Cue(NamedTuple):
    """A word to look for: one of these kinds, after one of these runs of words and, if it is a number (kind `#`), before one of these units."""

    kind: tuple[str, ...]
    lead: tuple[str, ...] = ()
    unit: tuple[str, ...] = ()
    times: int = 1


class Rule(NamedTuple):
    """What a text is called if it holds all cues, each behind the one before if they are in order."""

    label: str
    cues: list[Cue]
    in_order: bool = False


_WORD = r"([a-z]+|\d[\d,]*(?:\.\d+)?)"


def _said(text: Text) -> Column:
    """Words and numbers of a lower-cased text, a space before, between and behind them."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(_WORD), F.lit(1))
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))


def _named(classes: dict[str, list[str]]) -> str:
    """A look ahead that refuses numbers which a class lists as words."""
    digits = [w for words in classes.values() for w in words if w[0].isdigit()]
    return f"(?!(?:{'|'.join(digits)}) )" if digits else ""


def _either(kinds: tuple[str, ...], classes: dict[str, list[str]], number: str = "#") -> str:
    """A pattern of the words of any of these kinds: what the class lists, and the kind as a word unless another class lists it."""
    listed = {w for words in classes.values() for w in words}
    words = [w for k in kinds for w in ([number] if k == "#" else [*classes.get(k, []), *([] if k in listed else [k])])]
    return f"(?:{'|'.join(dict.fromkeys(words))})" if words else "(?!)"


def _fit(cue: Cue, classes: dict[str, list[str]], number: str = "#") -> str:
    """A pattern of a word that a cue finds; behind and before it only looks."""
    leads = ["".join(f" {_either((k,), classes)}" for k in x.split()) + " " for x in cue.lead]
    behind = f"(?:{'|'.join(f'(?<={x})' for x in leads)})" if leads else "(?<= )"
    return f"{behind}{_either(cue.kind, classes, number)}(?= {_either(cue.unit, classes) + ' ' if cue.unit else ''})"


def pattern_of(rule: Rule, classes: dict[str, list[str]]) -> str:
    """One pattern for all cues of a rule. Each looks for its first word and never goes back, so time grows with the text."""
    if rule.in_order:
        return "^" + "".join(f"(?>.*?{_fit(c, classes)})" for c in rule.cues)
    return "^" + "".join("(?=" + f"(?>.*?{_fit(c, classes)})" * c.times + ")" for c in rule.cues)


def first_rule(text: Text, classes: dict[str, list[str]], rules: list[Rule]) -> Column:
    """The label of the first rule that a text meets, else null.

    The kind of a word is the class that lists it, else the word; of a number `#`. The text is cut into words once, and a rule is
    one pattern over them.
    """
    kinds = F.regexp_replace(_said(text), rf" {_named(classes)}\d[\d,.]*(?= )", " #")

    def chosen(said: Column) -> Column:
        out = F.lit(None).cast("string")
        for rule in reversed(rules):
            out = F.when(F.rlike(said, F.lit(pattern_of(rule, classes))), rule.label).otherwise(out)
        return out

    return bound(kinds, chosen)


def value_behind(text: Text, classes: dict[str, list[str]], name: Cue, number: Cue) -> Column:
    """The first number that one cue finds behind the first word that another finds; their leads are not looked at."""
    digits = rf"(?:{_named(classes)}\d[\d,]*(?:\.\d+)?)"
    pattern = f"^(?>.*?{_fit(name._replace(lead=()), classes, digits)})(?>.*?(?<= )({digits})(?= {_either(number.unit, classes, digits)} ))"
    return F.replace(F.regexp_extract(_said(text), pattern, 1), F.lit(","), F.lit("")).try_cast("double")


def mentions(text: Column, window: int = 5) -> Column:
    """Every number of a text with the words next to it: an array of (value, before, after), `window` words to either side."""
    all_ = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z]+|\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    value = lambda w: F.replace(w, F.lit(","), F.lit("")).try_cast("double")
    # The words are bound once, as the only element of an array, so that they are not worked out for every number.
    around = lambda ws: F.transform(ws, lambda w, i: F.struct(value(w).alias("value"), F.slice(ws, F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window))).alias("before"), F.slice(ws, i + 2, F.lit(window)).alias("after")))
    return F.filter(F.flatten(F.transform(F.array(all_), around)), lambda m: m["value"].isNotNull())


def near(words: Column, stems: list[str]) -> Column:
    """Whether some word of an array begins with each of the stems; `a|b` is either."""
    begins = lambda stem: F.exists(words, lambda w: F.rlike(w, F.lit(f"^(?:{stem})")))
    out = F.lit(True)
    for stem in stems:
        out = out & begins(stem)
    return out
