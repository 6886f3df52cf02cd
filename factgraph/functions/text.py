"""Scalar text functions as Spark columns; all of them stay within the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that the results depend on.
STOP_WORDS = (
    "a is the an and are as at be but by for if in into it no not of on or such that their then there these they this to was will with"
).split()
AUXILIARY_PREFIXES = ("is ", "are ", "was ", "were ", "be ", "can be ", "may be ", "could be ", "should be ", "has been ", "have been ")
DROPPED_TOKENS = ("a", "an", "the", "of")


def norm_exact(c: Column) -> Column:
    """Lower case, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", " "))


def strip_plural(c: Column) -> Column:
    """Each token of the normalised name without its plural ending."""

    def token(t: Column) -> Column:
        n = F.length(t)
        long_ending = (n > 3) & t.endswith("es") & ~t.endswith("sses")
        ending = (n > 2) & t.endswith("s") & ~t.endswith("ss")
        return F.when(long_ending, F.substr(t, F.lit(1), n - 2)).when(ending, F.substr(t, F.lit(1), n - 1)).otherwise(t)

    return F.array_join(F.transform(F.split(norm_exact(c), " "), token), " ")


def norm_fuzzy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(norm_exact(c), r"[^a-z0-9' ]", " "), r" +", " "))


def _let(value: Column, make) -> Column:
    """make(value) with value computed once, however often make refers to it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def name_entropy(c: Column) -> Column:
    """Shannon entropy in bits over the characters other than blanks; 0 for none."""

    def bits(chars: Column) -> Column:
        n = F.size(chars).cast("double")

        def part(total: Column, ch: Column) -> Column:
            p = F.size(F.filter(chars, lambda x: x == ch)).cast("double") / n
            return total - p * F.log2(p)

        return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), part)

    return _let(F.filter(F.split(F.replace(c, F.lit(" "), F.lit("")), ""), lambda x: x != ""), bits)


def high_entropy(c: Column, least_length: int = 6, least_tokens: int = 2, least_bits: float = 1.5) -> Column:
    """Whether a normalised name says enough to be matched loosely."""
    tokens = F.size(F.filter(F.split(c, " "), lambda x: x != ""))
    return ~((F.length(c) < least_length) & (tokens < least_tokens)) & (name_entropy(c) >= least_bits)


def shingles(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams without blanks; a single character is its own shingle, two make none."""
    t = F.replace(c, F.lit(" "), F.lit(""))
    size = F.length(t)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substr(t, i, F.lit(n))))
    none = F.array().cast("array<string>")
    return F.when(size == 0, none).when(size < n - 1, F.array(t)).when(size < n, none).otherwise(grams)


#: Hashes of a signature.
SIGNATURE = 32


def minhash_signature(sh: Column, perms: int = SIGNATURE) -> Column:
    """For each seed the smallest md5 of 'seed:shingle'; empty for no shingle."""
    low = lambda seed: F.array_min(F.transform(sh, lambda x: F.md5(F.concat(seed.cast("string"), F.lit(":"), x))))
    return F.when(F.size(sh) > 0, F.transform(F.sequence(F.lit(0), F.lit(perms - 1)), low)).otherwise(F.array().cast("array<string>"))


def lsh_bands(signature: Column, rows: int = 4, bands: int = 8) -> Column:
    def of(sig: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.concat(i.cast("string"), F.lit("|"), F.array_join(F.slice(sig, i * rows + 1, F.lit(rows)), "-")))

    return _let(signature, of)


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets, 0 if one is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.size(F.array_union(a, b)))


def normalize_relation(c: Column) -> Column:
    """Relation name in words: separators to blanks, auxiliaries in front stripped one after another, articles dropped."""
    t = F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    for prefix in AUXILIARY_PREFIXES:  # one reference to t a step, or the expression triples with each
        t = F.regexp_replace(t, f"^{prefix}", "")
    return F.array_join(F.filter(F.split(t, " "), lambda x: ~x.isin(*DROPPED_TOKENS) & (x != "")), " ")


def sanitize_label(c: Column, fallback: str = "RELATED_TO") -> Column:
    t = F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_]+", "_"), r"_+", "_"), r"^_|_$", ""))
    return F.when(F.length(t) > 0, t).otherwise(F.lit(fallback))


def extract_label(reply: Column, choices: list[str], fallback: str) -> Column:
    """A model's reply as one of the choices, verbatim, or the fallback; without choices as a label.

    Of the marks line break, full stop, semicolon and comma the first that is present cuts, the others do not. List marks
    in front go, then blanks, double quotes, single quotes and blanks again at both ends. Case decides only between
    choices that differ in nothing else.
    """
    marks = ("\n", ".", ";", ",")
    text = F.coalesce(reply, F.lit(""))
    cut = reduce(lambda c, m: c.when(F.instr(text, m) > 0, F.substring_index(text, m, 1)), marks[1:], F.when(F.instr(text, marks[0]) > 0, F.substring_index(text, marks[0], 1))).otherwise(text)
    clean = F.regexp_replace(cut, r"^[\-\*• ]+", "")
    for ends in (r"\s", '"', "'", r"\s"):
        clean = F.regexp_replace(clean, f"^{ends}+|{ends}+$", "")
    if not choices:
        return sanitize_label(clean, fallback or "UNKNOWN")
    exact = reduce(lambda c, x: c.when(clean == x, F.lit(x)), choices[1:], F.when(clean == choices[0], F.lit(choices[0])))
    loose = reduce(lambda c, x: c.when(F.lower(clean) == x.lower(), F.lit(x)), choices[1:], F.when(F.lower(clean) == choices[0].lower(), F.lit(choices[0])))
    return F.coalesce(exact, loose, F.lit(fallback or choices[0]))


def truncate_at_sentence(c: Column, most: int = 500) -> Column:
    """At most that many characters, back to the last end of a sentence among them if there is one."""
    head = F.substr(c, F.lit(1), F.lit(most))
    ended = F.regexp_extract(head, r"(?s)^(.*[.!?])(\s|$)", 1)
    return F.when(F.length(c) <= most, c).when(F.length(ended) > 0, F.rtrim(ended)).otherwise(F.rtrim(head))


def clean_input(c: Column) -> Column:
    """Without zero-width characters and control characters other than line breaks and tabs."""
    return F.regexp_replace(c, "[​-‏﻿⁠\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f]", "")


def chunk_label(name: Column, uuid: Column) -> Column:
    """The number behind the last '-part_', else the uuid."""
    part = F.regexp_extract(name, r"^.*-part_([0-9]+)$", 1)
    return F.when(F.length(part) > 0, part).otherwise(uuid)


def format_secs(c: Column) -> Column:
    s = c.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def json_salvage(c: Column) -> Column:
    """The JSON in a model's reply: a fenced block, any fence, the outermost braces, or the reply itself."""
    fenced = F.regexp_extract(c, r"(?s)```json\s*(.*?)\s*```", 1)
    any_fence = F.regexp_extract(c, r"(?s)```\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(any_fence != "", any_fence).when(braces != "", braces).otherwise(F.trim(c))


def escape_tsv(c: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def lucene_sanitize(c: Column) -> Column:
    """A backslash before each reserved character, and before the capitals of the operators OR, NOT and AND."""
    return F.regexp_replace(c, r'([+\-&|!(){}\[\]^"~*?:\\/ORNTAD])', r"\\$1")


def fulltext_query(c: Column, most: int = 128) -> Column:
    """Words other than stop words joined by ' | '; empty if words and bars are ``most`` or more."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"""[,.<>{}\[\]"':;!@#$%^&*()\-+=~?|/\\]""", " "), r"\s+", " "))
    words = F.filter(F.split(t, " "), lambda w: (w != "") & ~F.lower(w).isin(*STOP_WORDS))
    return F.when(F.size(words) * 2 - 1 >= most, F.lit("")).otherwise(F.array_join(words, " | "))


def lucene_query(c: Column, groups: Sequence[str] = (), most: int = 128) -> Column:
    """The sanitized query in brackets, behind its groups if there are any; empty if its words and the groups are ``most`` or more."""
    clean = lucene_sanitize(c)
    bound = " OR ".join(f'group_id:"{g}"' for g in groups)
    whole = F.concat(F.lit(f"{bound} AND (" if bound else "("), clean, F.lit(")"))
    return F.when(F.size(F.split(clean, " ")) + len(groups) >= most, F.lit("")).otherwise(whole)


def embedding_text(c: Column) -> Column:
    """A text as it is embedded: on one line."""
    return F.replace(c, F.lit("\n"), F.lit(" "))


def clean_name(c: Column) -> Column:
    return F.trim(F.translate(c, " ​﻿", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def sanitize_model_name(c: Column) -> Column:
    return F.translate(F.lower(c), ":. ", "---")


def cache_key(model: Column, messages: Column) -> Column:
    """Key of a model call: md5 of the model and its messages as JSON text."""
    return F.md5(F.concat(model, F.lit(":"), messages))


def quote_relation_type(c: Column) -> Column:
    """Quotes around a bare value of "relation_type" in JSON-like text."""
    return F.regexp_replace(c, r'("relation_type"\s*:\s*)([A-Za-z_][A-Za-z0-9_]*)(\s*[,}])', '$1"$2"$3')


def message_line(role: Column, role_type: Column, content: Column) -> Column:
    return F.concat(F.coalesce(role, F.lit("")), F.lit("("), role_type, F.lit("): "), content)
