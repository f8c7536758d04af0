"""Glosses of nested senses, register words, and the phonetic form that a spelling and a word share."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the longest parent gloss that is chained to its child
CHAIN_LIMIT = 40
LABEL = r"^\([^()]*\)\s*"
SCRIPT = r"[\x{A980}-\x{A9DF}]"
# fixed values: sounds of the script's consonants, vowel signs and other signs
CONSONANTS = {
    "ꦏ": "k", "ꦐ": "k", "ꦑ": "k", "ꦒ": "g", "ꦓ": "g", "ꦔ": "ng", "ꦕ": "c", "ꦖ": "c", "ꦗ": "j", "ꦘ": "ny", "ꦙ": "j", "ꦚ": "ny",
    "ꦛ": "th", "ꦜ": "th", "ꦝ": "dh", "ꦞ": "dh", "ꦟ": "n", "ꦠ": "t", "ꦡ": "t", "ꦢ": "d", "ꦣ": "dh", "ꦤ": "n", "ꦥ": "p", "ꦦ": "p",
    "ꦧ": "b", "ꦨ": "b", "ꦩ": "m", "ꦪ": "y", "ꦫ": "r", "ꦬ": "r", "ꦭ": "l", "ꦮ": "w", "ꦯ": "s", "ꦰ": "s", "ꦱ": "s", "ꦲ": "h",
}
VOWELS = {"ꦴ": "a", "ꦵ": "o", "ꦶ": "i", "ꦷ": "i", "ꦸ": "u", "ꦹ": "u", "ꦺ": "e", "ꦻ": "ai", "ꦼ": "e"}
OTHERS = {"ꦄ": "a", "ꦅ": "i", "ꦆ": "i", "ꦇ": "i", "ꦈ": "u", "ꦌ": "e", "ꦍ": "ai", "ꦎ": "o", "ꦉ": "re", "ꦊ": "le", "ꦀ": "m", "ꦁ": "ng", "ꦂ": "r", "ꦃ": "h", "ꦿ": "r", "ꦾ": "y", "ꦽ": "re"}
FOREIGN = {"p": "f", "w": "f", "j": "z"}
CECAK, KILLER, VOWEL_E, VOWEL_A, KERET = "꦳", "꧀", "ꦺ", "ꦴ", "ꦽ"


def _shorn(text: Column, signs: str) -> Column:
    return F.regexp_replace(text, f"[{signs}]+$", "")


def sense_glosses(chain: Column) -> Column:
    """array<string>: the glosses of one sense out of its chain of glosses, outermost first.

    A short parent leads its child ("house: abode"), a label leads with a space, a parent of more than CHAIN_LIMIT characters is a
    gloss of its own whose label its child inherits. A child that is only a label follows its parent; one with a label of its own inherits none and a label that
    it shares with a parent stands once. Chains that hold rests of templates give nothing.
    """
    parts = F.array_distinct(F.filter(F.transform(chain, lambda x: _shorn(x, " :,;")), lambda x: x != ""))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("lead"), F.lit("").alias("passed"), F.array().cast("array<string>").alias("labels"))

    def parent(s: Column, x: Column) -> Column:
        short = _shorn(x, ".")
        labelled = short.rlike(LABEL)
        label, body = F.rtrim(F.regexp_extract(short, LABEL, 0)), F.regexp_replace(short, LABEL, "")
        long = F.length(body) > CHAIN_LIMIT
        return F.struct(
            F.when(long, F.array_append(s["out"], F.concat(s["lead"], x))).otherwise(s["out"]).alias("out"),
            F.when(long, "").otherwise(F.concat(s["lead"], short, F.when(body == "", " ").otherwise(": "))).alias("lead"),
            F.when(long, F.when(labelled, F.concat(label, F.lit(" "))).otherwise("")).otherwise(s["passed"]).alias("passed"),
            F.when(labelled, F.array_append(s["labels"], label)).otherwise(s["labels"]).alias("labels"),
        )

    def child(s: Column, own: Column) -> Column:
        shared = F.get(F.filter(s["labels"], lambda x: F.startswith(own, F.concat(x, F.lit(" ")))), F.lit(0))
        lead = F.when(shared.isNotNull() & (F.trim(s["lead"]) == shared), "").otherwise(s["lead"])
        rest = F.when(shared.isNotNull() & (lead != ""), F.ltrim(F.substr(own, F.length(shared) + 1))).otherwise(own)
        gloss = F.when(own.rlike(r"^\([^()]*\)$"), F.trim(F.concat(_shorn(s["lead"], ": "), F.lit(" "), own)))
        gloss = gloss.when(F.startswith(own, F.lit("(")), F.concat(lead, rest)).otherwise(F.concat(s["passed"], s["lead"], own))
        return F.array_append(s["out"], gloss)

    folded = F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), zero, parent)
    broken = F.exists(parts, lambda x: F.contains(x, F.lit("{{")) | F.contains(x, F.lit(":Template:")))
    return F.when(broken, F.array().cast("array<string>")).when(F.size(parts) < 2, parts).otherwise(child(folded, F.try_element_at(parts, F.lit(-1))))


def mend(text: Column) -> Column:
    """Signs of the script that were parted from their letter by white space, joined again."""
    return F.regexp_replace(text, rf"(?<={SCRIPT})\s+(?=[\x{{A980}}-\x{{A983}}\x{{A9B3}}-\x{{A9C0}}])", "")


def register_words(text: Column) -> Column:
    """array<string>: the words of one register, listed by commas, semicolons or the script's comma.

    A form in script that a Latin form follows, in brackets or as the next item, is one word, its first Latin form; further Latin
    items are older spellings of it. Without a Latin form the script stays. Latin items before any script are words of their own.
    """
    items = F.filter(F.transform(F.split(mend(text), "[,;\\x{A9C8}]", -1), lambda x: F.trim(x)), lambda x: x != "")
    zero = F.struct(F.array().cast("array<string>").alias("words"), F.lit("word").alias("at"))
    paired = rf"^(?:{SCRIPT}|[\x{{200C}} -])+\(([^()]+)\)$"

    def step(s: Column, x: Column) -> Column:
        both, script = x.rlike(paired), x.rlike(SCRIPT)
        put = F.array_append(s["words"], F.when(both, F.trim(F.regexp_extract(x, paired, 1))).otherwise(x))
        swap = F.array_append(F.slice(s["words"], F.lit(1), F.greatest(F.size(s["words"]) - 1, F.lit(0))), x)
        words = F.when(both | script | (s["at"] == "word"), put).when(s["at"] == "script", swap).otherwise(s["words"])
        return F.struct(words.alias("words"), F.when(both, "latin").when(script, "script").when(s["at"] == "script", "latin").otherwise(s["at"]).alias("at"))

    # without any script every item is a word, and long lists need no fold
    return F.when(~text.rlike(SCRIPT), items).otherwise(F.aggregate(items, zero, step, lambda s: s["words"]))


_SYLLABLE = re.compile(f"(?P<c>[{''.join(CONSONANTS)}])(?P<f>{CECAK}?)(?P<m>[ꦿꦾꦽ]*)(?P<v>[{''.join(VOWELS)}{KILLER}]*)|(?P<o>.)", re.S)


def sounds(script: str) -> str:
    """Latin letters of a text in the script, syllable by syllable; signs without a sound are left out."""
    out = []
    for s in _SYLLABLE.finditer(script):
        if s["c"] is None:
            out.append(OTHERS.get(s["o"], ""))
            continue
        first = FOREIGN.get(CONSONANTS[s["c"]], CONSONANTS[s["c"]]) if s["f"] else CONSONANTS[s["c"]]
        vowel = "e" if KERET in s["m"] else "a"
        if KILLER in s["v"]:
            vowel = ""
        elif s["v"]:
            vowel = "o" if VOWEL_E in s["v"] and VOWEL_A in s["v"] else "".join(VOWELS[v] for v in s["v"])
        out.append(first + "".join(OTHERS[m][0] for m in s["m"]) + vowel)
    return "".join(out)


#: (pattern, replacement) in order: what spelling habits blur.
BLURRED = (("[^a-z]", ""), ("dh", "d"), ("th", "t"), ("v", "f"), ("h", ""), ("ny(?=[cj])", "n"), ("ngng", "ng"), ("(?<=[ie])y(?=[aeiou])|(?<=[uo])w(?=[aeiou])", ""), (r"(.)\1+", r"\1"), ("o$", "a"))


def phonetic_latin(word: Column) -> Column:
    """The form in which a Latin word is compared: plain letters, with everything that spellings differ in blurred. Expects NFD without marks, see nfd_bare."""
    out = F.lower(word)
    for find, put in BLURRED:
        out = F.regexp_replace(out, find, put.replace("\\1", "$1"))
    return out


@F.pandas_udf(T.StringType())
def phonetic_script(script: pd.Series) -> pd.Series:
    """The same form of a spelling in script: equal forms mean that the spelling can be read as the word."""

    def form(text: str) -> str:
        out = "".join(c for c in unicodedata.normalize("NFD", sounds(text)) if unicodedata.category(c) != "Mn").lower()
        for find, put in BLURRED:
            out = re.sub(find, put, out)
        return out

    return script.map(lambda x: None if x is None else form(x))


# taken where it stands: a join on it asks no row before a distinct() whether it has one
phonetic_script = phonetic_script.asNondeterministic()
