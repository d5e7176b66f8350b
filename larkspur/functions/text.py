"""Column functions over text; all run inside Spark."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from . import values as V

#: White space as Unicode has it, with the four separators U+001C to U+001F.
SPACE = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: The same, character by character.
SPACES = "".join(chr(c) for c in range(0x3001) if re.match(SPACE, chr(c)))


def literals(words: Iterable[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if (words := list(words)) else F.array().cast("array<string>")


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of x, which is worked out once however often `then` names it."""
    return F.transform(F.array(x), then)[0]


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like those wanted that none of those taken equals, whatever its case."""
    taken, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def stripped(x: Column, chars: str | None = None) -> Column:
    """Without white space (or the characters given) at both ends."""
    cls = SPACE if chars is None else "[" + escaped(chars) + "]"
    return F.regexp_replace(x, f"^{cls}+|{cls}+$", "")


def escaped(chars: str) -> str:
    return "".join("\\" + c if c in "[]\\^-&" else c for c in chars)


def collapsed(x: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def tokens(x: Column) -> Column:
    """Words between white space. Each such character becomes a blank first: to split at one character needs no pattern."""
    return F.filter(F.split(F.translate(x, SPACES, " " * len(SPACES)), " "), lambda t: t != "")


def normalised_title(x: Column) -> Column:
    return collapsed(F.lower(x))


def visible(x: Column) -> Column:
    """Without zero-width and direction marks, trimmed."""
    return stripped(F.translate(x, V.INVISIBLE, ""))


def leading_tag(x: Column) -> Column:
    """The words of a leading bracket of 1 to 32 characters; empty if there is none."""
    return F.regexp_extract(x, rf"^{SPACE}*\[([^\]]{{1,32}})\]", 1)


def subject_words(x: Column) -> Column:
    """Lower-case words in each useful form: whole, parts of hyphenated ones, without apostrophes, and what stands before one."""
    found = F.regexp_extract_all(F.lower(x), F.lit("([a-zà-ÿ'-]+)"), F.lit(1))
    none = F.array().cast("array<string>")

    def forms(t: Column) -> Column:
        parts = F.when(F.contains(t, F.lit("-")), F.split(t, "-")).otherwise(none)
        bare = F.when(F.contains(t, F.lit("'")), F.array(F.replace(t, F.lit("'"), F.lit("")), F.split_part(t, F.lit("'"), F.lit(1)))).otherwise(none)
        return F.concat(F.array(t), parts, bare)

    return F.array_distinct(F.filter(F.flatten(F.transform(found, forms)), lambda t: t != ""))


def last_word(x: Column) -> Column:
    return F.try_element_at(tokens(F.lower(x)), F.lit(-1))


def title_names(x: Column, stop: Iterable[str] = V.NOT_NAMES) -> Column:
    """Distinct capitalised runs of a title, stop words left out of them, longer than three characters.

    The words of a run repeat possessively: nothing follows them, so the match is the same, and Java goes through them in a loop and not by recursion, which a run of
    some thousand words would end with the executor's stack.
    """
    runs = F.regexp_extract_all(x, F.lit(rf"(?U)(?<!\w)([A-Z][a-zà-ÿ']+(?:{SPACE}+[A-Z][a-zà-ÿ']+)*+)"), F.lit(1))
    stops = literals(stop)
    names = F.transform(runs, lambda r: F.array_join(F.filter(tokens(r), lambda w: ~F.array_contains(stops, F.lower(w))), " "))
    return F.array_distinct(F.filter(names, lambda n: F.length(n) > 3))


#: Letters with marks, to their plain letters: what canonical decomposition leaves of one letter and its marks, up to U+1EFF.
FOLDS = {chr(c): d[0] for c in range(0xC0, 0x1F00) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and not unicodedata.combining(d[0]) and all(unicodedata.combining(x) for x in d[1:])}
SHAPES = {"’": "'", "‘": "'", "ʼ": "'", "´": "'", "‑": "-", "–": "-", "—": "-"}


def comparable(x: Column) -> Column:
    """One spelling of a name: apostrophes and dashes of one shape, letters without marks."""
    folds = SHAPES | FOLDS
    return F.regexp_replace(F.translate(x, "".join(folds), "".join(folds.values())), r"\p{Mn}", "")


def depossessed(x: Column) -> Column:
    return F.regexp_replace(stripped(x, " .,;:"), "['’]s?$", "")


def normalised_word(x: Column) -> Column:
    return depossessed(F.lower(stripped(x, V.TRAILING)))


def name_words(x: Column) -> Column:
    return F.filter(F.transform(tokens(comparable(x)), lambda w: depossessed(F.lower(w))), lambda w: w != "")


def sentences(x: Column) -> Column:
    return F.split(x, rf"(?<=[.!?])[\"'”’»）)\]]*{SPACE}+", -1)


def scanned_names(x: Column, min_words: int = 2, break_on_punctuation: bool = False, separators: str = V.SEPARATORS) -> Column:
    """Runs of at least min_words capitalised words, in order.

    Words that end a run, and those that are none of a name, put a mark into the joined text; the runs lie between the marks.
    """
    mark = "\x02"

    def shown(t: Column) -> Column:
        word = F.regexp_replace(t, "[" + escaped(V.TRAILING) + "]+$", "")
        tail = F.substring(t, F.length(word) + 1, F.length(t))
        ends = tail != "" if break_on_punctuation else F.lit(False)
        if separators:
            ends = ends | tail.rlike("[" + escaped(separators) + "]")
        return F.when(word.rlike(r"^\p{Lu}[\p{L}'’.\-]*$"), F.concat(word, F.when(ends, F.lit(mark)).otherwise(F.lit("")))).otherwise(F.lit(mark))

    runs = F.transform(F.split(F.array_join(F.transform(tokens(x), shown), " "), mark), lambda r: F.trim(r))
    return F.filter(runs, lambda r: (r != "") & (F.size(F.split(r, " ")) >= min_words))


def trimmed_name(x: Column, starters: Iterable[str] = V.SENTENCE_STARTERS) -> Column:
    """Without one leading sentence starter, if something else remains."""
    parts = tokens(x)
    first = F.array_contains(literals(starters), F.lower(F.try_element_at(parts, F.lit(1))))
    return F.when((F.size(parts) > 1) & first, F.array_join(F.slice(parts, 2, 10_000), " ")).otherwise(x)


def figures(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit("(?i)" + V.FIGURE), F.lit(1)))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def has_preamble(x: Column) -> Column:
    return stripped(x).rlike("(?i)" + V.PREAMBLE)


def truncated(x: Column, limit: int = V.SUMMARY_CHARS) -> Column:
    """At most `limit` characters, cut at a blank where there is one, with an ellipsis."""
    whole = collapsed(x)
    cut = F.substring(whole, 1, limit - 1)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.regexp_replace(cut, r"(?s)^(.+) [^ ]*$", "$1"), F.lit("…")))


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(10, 20)
    end = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def tidy(x: Column) -> Column:
    """Paragraphs apart by one blank line, white space inside them collapsed, none empty."""
    parts = F.transform(F.split(stripped(x), r"\n[ \t\r\f\x0b]*\n\s*"), collapsed)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def note_lines(x: Column) -> Column:
    """Lines that are list items: a dash, star or bullet, or a digit with a dot among the first three characters."""
    lines = F.transform(F.split(x, r"\r?\n"), lambda line: stripped(line))
    return F.filter(lines, lambda line: line.rlike(r"^[-*•]") | (line.rlike(r"^[0-9]") & F.contains(F.substring(line, 1, 3), F.lit("."))))


def is_final(status: Column) -> Column:
    return F.startswith(F.lower(stripped(status)), F.lit("final"))


def season(day: Column) -> Column:
    return F.when(F.month(day) < 10, F.year(day) - 1).otherwise(F.year(day))


def rfc822(x: Column) -> Column:
    """Timestamp of an RFC 822 or ISO 8601 date; zone names stand for their own fixed offsets; null if it is neither. A date without a zone is UTC."""
    bare = F.regexp_replace(F.trim(x), r"^[A-Za-z]{3,9},?\s+", "")
    name = F.regexp_extract(bare, r"\s([A-Za-z]{1,4})$", 1)
    offset = F.coalesce(*(F.when(F.upper(name) == zone, F.lit(to)) for zone, to in V.ZONES.items()))
    fixed = F.when(name != "", F.concat(F.regexp_replace(bare, r"[A-Za-z]{1,4}$", ""), offset)).otherwise(bare)
    forms = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yy HH:mm:ss Z")
    return F.coalesce(*(F.try_to_timestamp(fixed, F.lit(f)) for f in forms), F.try_to_timestamp(x))
