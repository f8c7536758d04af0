"""Text expressions: normal forms, script classes, word cleaning, syllables, spelling rules, keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.alignment import distance

# fixed values: the script block, its virama and the spelling rules' letters
BLOCK = r"[\x{A980}-\x{A9DF}]"
LETTER = r"[\x{A980}-\x{A9DF}&&[\p{Lo}]]"
MARK = r"[\p{Mn}\p{Mc}\p{Me}\p{Cf}]"
VIRAMA = r"\x{A9C0}"
MAX_CHAIN = 3
# fixed values: Latin letters and signs that the cleaner replaces or deletes
REPLACED = ("åÅêÊôÔèÈ-–—/;!?", "aAeEoOéÉ    ,..")
DELETED = "\"'“”‘’«»"
WORD = r"^[(]*[a-zé0-9]+[,.:)]*$"
ACRONYM = r"^[(]*[A-Z]{2,}[,.:)]*$"
SYLLABLE = rf"(?s)(?:(?!{MARK}).{MARK}*(?:(?<={VIRAMA}){LETTER}{MARK}*)*)|{MARK}+(?:(?<={VIRAMA}){LETTER}{MARK}*)*"
GLOTTAL = r"(?<![^\saiueoé])h(?=[aiueoé])"


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all shuffle partitions. Distinct words are few bytes, so that adaptive execution would leave them, and a costly function of each, to one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC; plain ASCII rows pass as they are."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def nfd_bare(s: pd.Series) -> pd.Series:
    """NFD without nonspacing marks."""
    return s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


#: The same, taken where it stands: a join on it asks no row before a distinct() whether it has one.
nfd_bare_once = F.pandas_udf(nfd_bare.func, T.StringType()).asNondeterministic()


def cleaned(text: Column) -> Column:
    """The character replacements of word cleaning; NFC is the caller's."""
    return F.translate(text, REPLACED[0] + DELETED, REPLACED[1])


def clean_words(text: Column) -> Column:
    """array<string>: words fit for transliteration; null where a word breaks the line (acronyms, other signs)."""
    raw = F.filter(F.split(cleaned(text), r"(?U)\s+", -1), lambda w: w != "")
    return F.transform(raw, lambda w: F.when(w.rlike(ACRONYM), None).when(F.lower(w).rlike(WORD), F.lower(w)))


def n_valid(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.isNotNull()))


def logical_syllables(text: Column) -> Column:
    """array<string>: base and its marks, a virama joining the next letter; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(SYLLABLE), F.lit(0))


def is_well_formed(text: Column) -> Column:
    """Every mark follows a letter of the script or another mark."""
    return ~text.rlike(rf"(?<!{LETTER}|{MARK}){MARK}")


def longest_chain(text: Column) -> Column:
    """The most virama-and-letter pairs in a row."""
    runs = F.regexp_extract_all(text, F.lit(rf"(?:{VIRAMA}[\x{{A984}}-\x{{A9B2}}])+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: (F.length(r) / 2).cast("int"))), F.lit(0))


def valid_script(text: Column) -> Column:
    return (F.length(text) > 0) & text.rlike(rf"^{BLOCK}*$") & is_well_formed(text) & (longest_chain(text) <= MAX_CHAIN)


def syllable_pattern(syllable: Column) -> Column:
    """Letters of the script as L, other characters as hex code points, joined by spaces (BMP only)."""
    one = lambda c: F.when(c.rlike(rf"^{LETTER}$"), "L").otherwise(F.hex(F.encode(c, "UTF-16BE")))
    return F.array_join(F.transform(F.split(syllable, "", -1), one), " ")


def inversions(order: Column) -> Column:
    """Pairs of an integer array that stand in falling order."""
    n = F.size(order)
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    per = F.transform(at, lambda i: F.size(F.filter(at, lambda j: (j > i) & (F.get(order, i) > F.get(order, j)))))
    return F.aggregate(per, F.lit(0), lambda a, x: a + x)


def apply_permutation(text: Column, perm: Column) -> Column:
    return F.array_join(F.transform(perm, lambda i: F.substring(text, i + 1, F.lit(1))), "")


def canonical_permutation(syllable: Column, prebase: Column) -> Column:
    """Positions of pre-base marks first, the others after them, both in order."""
    chars = F.split(syllable, "", -1)
    at = F.sequence(F.lit(0), F.length(syllable) - 1)
    front = lambda i: F.array_contains(prebase, F.get(chars, i))
    return F.when(F.length(syllable) > 0, F.concat(F.filter(at, front), F.filter(at, lambda i: ~front(i)))).otherwise(F.array().cast("array<int>"))


def roundtrip_cer(latin: Column, back: Column) -> Column:
    """Edits per character after lower-casing, e-grave as e-acute, and dropping glottal h on both sides."""
    norm = lambda c: F.regexp_replace(F.translate(F.lower(c), "è", "é"), GLOTTAL, "")
    return distance(norm(latin), norm(back)) / F.greatest(F.lit(1), F.length(norm(latin)))


# fixed values: spelling rules as (name, pattern, replacement), in their order
RULES = (
    ("nya", "ꦤ(?=꧀[ꦕꦗ])", "ꦚ"),
    ("cerek", "(?<!꧀)ꦫꦼ", "ꦉ"),
    ("lelet", "(?<!꧀)ꦭꦼ", "ꦊ"),
    ("keret", "ꦿꦼ", "ꦽ"),
    ("pangkat", "(?<![꧐-꧙꧇])([꧐-꧙]+(?:[.,:][꧐-꧙]+)*)(?![꧐-꧙꧇])", "꧇$1꧇"),
)


def _with(value: Column, then) -> Column:
    """then(value), the value taken once however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _rule(find: str, put: str):
    """One spelling rule; a result that is not well formed is not taken."""
    return lambda t: _with(F.regexp_replace(t, find, put), lambda new: F.when(is_well_formed(new), new).otherwise(t))


def standardize(text: Column, only: tuple[str, ...] | None = None) -> Column:
    """The spelling rules one after the other; a result that is not well formed is not taken."""
    for name, find, put in RULES:
        if only is None or name in only:
            text = _with(text, _rule(find, put))
    return text


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]", "")


def lookup_key(bare: Column) -> Column:
    """Dictionary key of a text already without marks: lower case, one kind of quote, single spaces."""
    one = F.translate(F.lower(bare), "’‘`", "'''")
    return F.trim(F.regexp_replace(F.regexp_replace(one, r"[^\p{L}\p{N}' -]", " "), r" +", " "))


def escape_like(needle: str) -> str:
    """A typed word as a LIKE pattern that means itself (escape character: backslash)."""
    return needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def md5_mod100(text: Column) -> Column:
    """The 128-bit MD5 of a text, mod 100."""
    h = F.md5(text)
    half = lambda a: F.conv(F.substring(h, a, 16), 16, 10).cast("decimal(20,0)") % 100
    return ((half(1) * 16 + half(17)) % 100).cast("int")


def split_of(key: Column) -> Column:
    """train, val or test by the key's MD5: 90, 5 and 5 in 100."""
    b = md5_mod100(key.cast("string"))
    return F.when(b < 90, "train").when(b < 95, "val").otherwise("test")


def sentences(text: Column) -> Column:
    """Sentences of a text: split at \\n, and after . ! ? and an ellipsis before white space."""
    parts = F.flatten(F.transform(F.split(text, "\n", -1), lambda p: F.split(p, r"(?<=[.!?…])\s+", -1)))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def markup_to_text(markup: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, common entities are read, space is squeezed."""
    out = F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\x0B\f\r]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def ctc_collapse(ids: Column) -> Column:
    """Token ids without repeats and blanks (0)."""
    return F.filter(F.filter(ids, lambda x, i: (i == 0) | (x != F.get(ids, i - 1))), lambda x: x != 0)
