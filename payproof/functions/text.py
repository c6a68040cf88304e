"""Names, persons, invoice numbers and other text keys as Column expressions."""
from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from payproof import schema as S

# Every character Unicode calls white space; Spark's own trim only removes blanks.
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
ASCII_ONLY = r"^\p{ASCII}*$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def upper_strip(c: Column) -> Column:
    return F.upper(strip(c))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


@functools.lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, dict[str, str]]:
    """Accent-folding tables worked out from the Unicode database, one character at a time: characters that become
    one character, characters that vanish (combining marks), and characters that become several."""
    one_from, one_to, gone, many = [], [], [], {}
    for point in range(0x80, 0xFFFE):
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3:
            continue                      # surrogates; Hangul syllables only re-spell themselves
        ch = chr(point)
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch.casefold())
                        if not unicodedata.combining(x))
        if plain == ch:
            continue
        if plain == "":
            gone.append(ch)
        elif len(plain) == 1:
            one_from.append(ch)
            one_to.append(plain)
        else:
            many[ch] = plain
    many.pop("ß")                         # common enough to be replaced on its own
    return "".join(one_from), "".join(one_to), "".join(gone), many


def _class_of(chars: str) -> str:
    """A pattern for one of these characters, neighbours written as ranges."""
    runs: list[list[str]] = []
    for ch in sorted(chars):
        if runs and ord(ch) == ord(runs[-1][1]) + 1:
            runs[-1][1] = ch
        else:
            runs.append([ch, ch])
    return "[" + "".join(a if a == b else f"{a}-{b}" for a, b in runs) + "]"


def let(value: Column, body) -> Column:
    """`body(value)` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(c: Column) -> Column:
    """Lower case without accents; letters of every script are kept. Plain ASCII text, nearly all of it, takes the
    first branch; the Unicode tables are only touched by the rest."""
    one_from, one_to, gone, many = _fold_tables()
    pairs = F.lit("\n".join(f"{k}\t{v}" for k, v in many.items()))

    def spell_out(s: Column) -> Column:
        letters = F.transform(F.split(s, ""), lambda ch: F.coalesce(
            F.try_element_at(F.str_to_map(pairs, F.lit("\n"), F.lit("\t")), ch), ch))
        # most text is ASCII by now; the class below is long, and slow to ask of each character
        return F.when(s.rlike(ASCII_ONLY), s).when(s.rlike(_class_of("".join(many))), F.array_join(letters, "")).otherwise(s)
    plain = F.replace(F.translate(c, one_from + gone, one_to), F.lit("ß"), F.lit("ss"))
    return F.lower(F.when(c.rlike(ASCII_ONLY), c).otherwise(let(plain, spell_out)))


def norm_name(c: Column) -> Column:
    """Company key: '&' reads as 'and', punctuation as a space, legal suffixes at the end and the word 'the' go."""
    words = F.btrim(F.regexp_replace(fold(F.replace(c, F.lit("&"), F.lit(" and "))),
                                     r"[^\p{L}\p{N}]+", " "))
    cut = F.regexp_replace(words, "(?:(?:^| )(?:" + "|".join(S.COMPANY_SUFFIXES) + "))+$", "")
    return F.btrim(F.regexp_replace(cut, "(?:^| )the(?= |$)", ""))


def person_parts(c: Column) -> Column:
    """Name parts in lower case, family name last; titles and suffixes dropped."""
    turned = F.regexp_replace(fold(c), r"(?s)^([^,]*),(.*)$", "$2 $1")
    parts = F.regexp_extract_all(turned, F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), 1)
    return F.filter(parts, lambda w: ~w.isin(S.PERSON_TITLES))


def person_key(c: Column) -> Column:
    """One key per spelling, whatever the order of the parts."""
    return F.array_join(F.array_sort(person_parts(c)), " ")


def same_person(a: Column, b: Column) -> Column:
    """Whether two lists of name parts are one person: equal; a one-word user name that fits the other's full name;
    or equal family names with equal first names or a fitting initial."""
    def last(p: Column) -> Column:
        return F.try_element_at(p, F.lit(-1))

    def first(p: Column) -> Column:
        return F.try_element_at(p, F.lit(1))

    def user_name_of(one: Column, full: Column) -> Column:
        f, l, u = first(full), last(full), first(one)
        return (F.size(full) >= 2) & ((u == F.concat(F.left(f, F.lit(1)), l)) | (u == F.concat(f, l))
                                      | (u == F.concat(l, F.left(f, F.lit(1)))))

    def test(x: Column, y: Column) -> Column:
        fx, fy = first(x), first(y)
        initial = ((F.length(fx) == 1) | (F.length(fy) == 1)) & (F.left(fx, F.lit(1)) == F.left(fy, F.lit(1)))
        return (F.when((F.size(x) == 0) | (F.size(y) == 0), False)
                .when(x == y, True)
                .when(F.size(x) == 1, user_name_of(x, y))
                .when(F.size(y) == 1, user_name_of(y, x))
                .when(last(x) != last(y), False)
                .otherwise((fx == fy) | initial))
    return F.exists(F.array(F.struct(a.alias("x"), b.alias("y"))), lambda p: test(p["x"], p["y"]))


def inv_key(c: Column) -> Column:
    """Invoice-number key: runs of letters and of digits joined by '-', leading zeros of a number dropped."""
    runs = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    split = F.regexp_replace(runs, "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", "-")
    return F.regexp_replace(F.btrim(split, F.lit("-")), "(^|-)0+(?=[0-9])", "$1")


def inv_text(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def similar_invoice(x: Column, y: Column) -> Column:
    """Whether two invoice texts (letters and digits only) read like one number keyed twice: one inside the other, two
    neighbouring characters swapped far apart in the series, or letters typed for look-alike digits."""
    shorter = F.least(F.length(x), F.length(y))
    differing = F.filter(F.sequence(F.lit(1), F.length(x)), lambda i: F.substr(x, i, F.lit(1)) != F.substr(y, i, F.lit(1)))

    def at(t: Column, k: Column) -> Column:
        return F.substr(t, k, F.lit(1))

    def number(t: Column) -> Column:
        digits = F.regexp_extract(t, "([0-9]+)[^0-9]*$", 1)
        return F.when((digits != "") & (F.length(digits) <= 12), digits.cast("bigint"))

    def swap_at(d: Column) -> Column:
        i, j = F.try_element_at(d, F.lit(1)), F.try_element_at(d, F.lit(2))
        return (F.size(d) == 2) & (j == i + 1) & (at(x, i) == at(y, j)) & (at(x, j) == at(y, i))
    swapped = F.exists(F.array(differing), swap_at)
    far = F.coalesce(F.abs(number(x) - number(y)) > 50, F.lit(True))

    def looks(t: Column) -> Column:
        return F.translate(t, S.LOOKALIKE_LETTERS, S.LOOKALIKE_DIGITS)
    return (F.when((x == "") | (y == "") | (x == y), False)
            .when((shorter >= 4) & (F.contains(x, y) | F.contains(y, x)), True)
            .when((F.length(x) != F.length(y)) | (F.length(x) < 4), False)
            .when(swapped, far)
            .otherwise(looks(x) == looks(y)))


# --- fixed values: patterns for roles ----------------------------------------
DIRECTOR = r"(?iU)\b(director|cfo|ceo|chief (financial|executive|operating) officer|managing partner)\b"
NOT_DIRECTOR = (r"(?iU)\b(?:to\s+(?:the\s+)?(?:\w+\s+)?(?:director|cfo|ceo|chief|managing)|"
                r"(?:assistant|associate)\s+(?:\w+\s+)?director)\b")


def is_director(role: Column) -> Column:
    return F.regexp_replace(role, NOT_DIRECTOR, " ").rlike(DIRECTOR)


def has_po(po_no: Column) -> Column:
    return ~upper_strip(po_no).isin(S.NO_PO)


def is_invoice_type(kind: Column) -> Column:
    return upper_strip(kind).isin(S.INVOICE_TYPES)


def po_exempt(vendor: Column, words: list[str] | None = None, vendors: list[str] | None = None) -> Column:
    """Bills that never carry a purchase order: an exempt phrase in the vendor's full name, or a listed vendor."""
    phrases = []
    for phrase in S.PO_EXEMPT_WORDS if words is None else words:
        parts = [w for w in re.findall("[a-z0-9]+", phrase.lower()) if w != "and"]
        if parts:
            phrases.append(r"\b" + r"\s+(?:and\s+)?".join(parts) + r"\b")
    full = F.btrim(F.regexp_replace(F.lower(F.replace(vendor, F.lit("&"), F.lit(" and "))), "[^a-z0-9]+", " "))
    exempt = full.rlike("|".join(phrases)) if phrases else F.lit(False)
    if vendors:
        exempt = exempt | norm_name(vendor).isin([plain_norm_name(v) for v in vendors])
    return exempt


def plain_norm_name(name: str) -> str:
    """The company key of one literal, for limits typed in by a person."""
    folded = "".join(x for x in unicodedata.normalize("NFKD", name.replace("&", " and ").casefold())
                     if not unicodedata.combining(x))
    words = re.sub(r"[\W_]+", " ", folded).split()
    while words and words[-1] in S.COMPANY_SUFFIXES:
        words.pop()
    return " ".join(w for w in words if w != "the")


def safe_cell(c: Column) -> Column:
    """Text a spreadsheet would run as a formula gets a leading apostrophe; a plain number stays a number."""
    risky = c.rlike(r"^[=+\-@\t\r]")
    return F.when(risky & c.try_cast("double").isNull(), F.concat(F.lit("'"), c)).otherwise(c)


def printable(c: Column) -> Column:
    """Control characters a workbook cannot hold are dropped."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def fingerprint(clause: Column, source_file: Column, title: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", clause, source_file, title), 256), 1, 16)


def labelled(header: Column, values: Column, text: Column) -> Column:
    """A row as 'column=value, ...'; the exact line when the widths differ."""
    pairs = F.zip_with(header, values, lambda h, v: F.concat(h, F.lit("="), F.when(v == "", "(empty)").otherwise(v)))
    return F.when(F.size(header) == F.size(values), F.array_join(pairs, ", ")).otherwise(text)


def line_no(c: Column) -> Column:
    """A line number sent by an outside tool as text: 12 or 12.0 count; 2.9, '--5' and huge numbers do not."""
    t = strip(c)
    return (F.when(t.rlike(r"^[0-9]{1,9}$"), t.cast("bigint"))
            .when(t.rlike(r"^[0-9]{1,9}\.0+$"), F.regexp_extract(t, "^([0-9]+)", 1).cast("bigint")))
