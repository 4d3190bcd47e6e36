"""Text functions as column expressions: keys, tokens, similarity, e-mail and HTML text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the plain letters they fold to.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyAAAAAAEEEEIIIIOOOOOUUUUNCY"
# Words of company forms, and words left out of port keys.
LEGAL_WORDS = ("SA", "SRL", "SAS", "LTDA", "LTD", "LIMITED", "INC", "LLC", "CORP", "CORPORATION", "CO", "COMPANY", "GMBH", "BV", "CV", "DE", "AND", "THE")
PORT_WORDS = ("PORT", "PUERTO", "PTO", "CHINA", "COSTA", "RICA")


def fold(c: Column) -> Column:
    """Without marks on letters."""
    return F.translate(c, MARKED, PLAIN)


def header_key(c: Column) -> Column:
    """Lower case, no marks, letters and digits only."""
    return F.regexp_replace(F.lower(fold(F.trim(c))), "[^a-z0-9]", "")


def lookup_key(c: Column) -> Column:
    return F.upper(header_key(c))


def tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct folded words of two characters or more, in order, without stop words."""
    words = F.split(F.regexp_replace(F.upper(fold(c)), "[^A-Z0-9]+", " "), " ")
    kept = F.filter(words, lambda w: F.length(w) >= 2)
    return F.array_except(F.array_distinct(kept), F.array(*[F.lit(s) for s in stop])) if stop else F.array_distinct(kept)


def company_key(c: Column) -> Column:
    """Tokens without legal words, sorted and joined."""
    return F.array_join(F.array_sort(tokens(c, LEGAL_WORDS)), "")


def port_key(c: Column) -> Column:
    """The first telling token before any bracket; null if there is none."""
    return F.try_element_at(F.filter(tokens(F.substring_index(c, "(", 1), PORT_WORDS), lambda w: F.length(w) >= 3), F.lit(1))


def acronym(c: Column) -> Column:
    """First letters of two to eight words, else null."""
    words = F.filter(F.split(F.regexp_replace(F.upper(fold(c)), "[^A-Z0-9]+", " "), " "), lambda w: w != "")
    letters = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return F.when(F.size(words).between(2, 8), letters)


def similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the greater length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def wildcard_equal(a: Column, b: Column) -> Column:
    """Equal keys of three characters or more, where ``?`` on either side stands for one character."""
    same = F.forall(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))) | (F.substr(a, i, F.lit(1)) == "?") | (F.substr(b, i, F.lit(1)) == "?"))
    return (F.length(a) == F.length(b)) & (F.length(a) >= 3) & same


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whole-word containment of folded text."""
    pad = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.upper(fold(c)), "[^A-Z0-9]+", " "), F.lit(" "))
    return F.contains(pad(text), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.upper(fold(phrase)), "[^A-Z0-9]+", " ")), F.lit(" ")))


def subject(c: Column) -> Column:
    """Without reply and forward marks; ``//`` and ``/`` between words become ``|``; one space."""
    bare = F.regexp_replace(c, r"(?i)^(\s*(re|rv|fw|fwd|enc|tr|wg|aw)\s*:)+\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s*(//|\\|\||\s/\s)\s*", " | "), r"\s+", " "))


def plain_text(c: Column) -> Column:
    """Line feeds only, no NBSP, no blanks at line ends, two line feeds in a row at most."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), " ", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


def html_text(c: Column) -> Column:
    """Text of HTML that keeps rows and columns: line breaks for blocks, tabs for cells, five entities decoded."""
    c = F.regexp_replace(c, "(?is)<script[^>]*>.*?</script>", " ")
    c = F.regexp_replace(c, "(?is)<style[^>]*>.*?</style>", " ")
    c = F.regexp_replace(c, "(?i)<(br|/p|/tr|/div|/li|/h[1-6])[^>]*>", "\n")
    c = F.regexp_replace(c, "(?i)</t[dh]>", "\t")
    c = F.regexp_replace(c, "(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.regexp_replace(c, " {2,}", " ")


def head_tail(c: Column, most: int, mark: str = "\n...\n") -> Column:
    """Texts above ``most`` characters: three quarters from the head, a mark, and a quarter from the tail."""
    head = most * 3 // 4
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(mark), F.right(c, F.lit(most - head))))


def csv_escape(c: Column) -> Column:
    return F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
