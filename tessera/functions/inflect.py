"""English plurals and singulars: as Python functions, Spark columns and SQL, all from the same tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide table names, in order of priority.
UNCOUNTABLE = (
    "equipment", "information", "rice", "money", "species", "series", "fish", "sheep", "jeans", "police", "news",
    "deer", "moose", "aircraft", "feedback", "software", "hardware",
)
UNCOUNTABLE_DOCUMENTS = (
    "advice", "energy", "excretion", "digestion", "cooperation", "health", "justice", "labour", "machinery",
    "pollution", "sewage", "paper", "rain", "expertise", "status", "media",
)
IRREGULAR = (("person", "people"), ("child", "children"), ("sex", "sexes"), ("move", "moves"), ("zombie", "zombies"))
MAN = "|wo|chair|sales|police|fire|business|spokes|post|work|crafts|gentle|middle|fresh|fisher|sports|door|milk"
PLURAL = (
    (r"(quiz)$", r"\1zes"),
    (r"^(oxen)$", r"\1"),
    (r"^(ox)$", r"\1en"),
    (r"^(m|l)ice$", r"\1ice"),
    (r"^(m|l)ouse$", r"\1ice"),
    (r"(matr|vert|ind)(?:ix|ex)$", r"\1ices"),
    (r"(x|ch|ss|sh)$", r"\1es"),
    (r"([^aeiouy]|qu)y$", r"\1ies"),
    (r"(hive)$", r"\1s"),
    (r"(?:([^f])fe|([lr])f)$", r"\1\2ves"),
    (r"sis$", r"ses"),
    (r"([ti])a$", r"\1a"),
    (r"([ti])um$", r"\1a"),
    (r"(buffal|tomat|potat)o$", r"\1oes"),
    (r"(bu)s$", r"\1ses"),
    (r"(alias|status)$", r"\1es"),
    (r"(octop|vir)i$", r"\1i"),
    (r"(octop|vir)us$", r"\1i"),
    (r"^(ax|test)is$", r"\1es"),
    (r"s$", r"s"),
    (r"$", r"s"),
)
SINGULAR = (
    (r"(database)s$", r"\1"),
    (r"(quiz)zes$", r"\1"),
    (r"(matr)ices$", r"\1ix"),
    (r"(vert|ind)ices$", r"\1ex"),
    (r"^(ox)en", r"\1"),
    (r"(alias|status)(es)?$", r"\1"),
    (r"(octop|vir)(us|i)$", r"\1us"),
    (r"^(a)x[ie]s$", r"\1xis"),
    (r"(cris|test)(is|es)$", r"\1is"),
    (r"(shoe)s$", r"\1"),
    (r"(buffal|tomat|potat|her|ech|vet)oes$", r"\1o"),
    (r"(bus)(es)?$", r"\1"),
    (r"^(m|l)ice$", r"\1ouse"),
    (r"(cache|niche|avalanche|ache|douche)s$", r"\1"),
    (r"(x|ch|ss|sh|zz)es$", r"\1"),
    (r"(m)ovies$", r"\1ovie"),
    (r"(s)eries$", r"\1eries"),
    (r"^(t|p|l|d)ies$", r"\1ie"),
    (r"(cook|zomb|calor|goal|self|rook|hood|freeb|smooth|brown|cutie|hipp)ies$", r"\1ie"),
    (r"([^aeiouy]|qu)ies$", r"\1y"),
    (r"([lr])ves$", r"\1f"),
    (r"(tive)s$", r"\1"),
    (r"(hive)s$", r"\1"),
    (r"([^f])ves$", r"\1fe"),
    (r"(^analy)(sis|ses)$", r"\1sis"),
    (r"((a)naly|(b)a|(d)iagno|(p)arenthe|(p)rogno|(s)ynop|(t)he)(sis|ses)$", r"\1sis"),
    (r"([ti])a$", r"\1um"),
    (r"(n)ews$", r"\1ews"),
    (r"(ss|sis)$", r"\1"),
    (r"s$", r""),
)
SINGULAR_US = (
    "abacus", "apparatus", "bonus", "bus", "cactus", "campus", "census", "chorus", "circus", "citrus", "consensus",
    "corpus", "exodus", "focus", "fungus", "genus", "hiatus", "impetus", "lotus", "minus", "nexus", "octopus", "onus",
    "plus", "prospectus", "radius", "sinus", "status", "stimulus", "surplus", "syllabus", "thesaurus", "torus",
    "virus", "walrus",
)


def _cases(plural: bool, documents: bool = False) -> list[tuple[str, str]]:
    """(pattern, replacement) pairs for a lower-case word; the first pattern found is applied once."""
    fixed = UNCOUNTABLE + (UNCOUNTABLE_DOCUMENTS if documents else ())
    cases = [(rf"^({'|'.join(fixed)})$", r"\1")]
    cases.append((rf"^({MAN})man$", r"\1men") if plural else (rf"^({MAN})men$", r"\1man"))
    for one, many in IRREGULAR:
        source, target = (one, many) if plural else (many, one)
        cases += [(rf"^(?:{source}|{target})$", target), (rf"^(.{{3,}}){source}$", rf"\1{target}")]
    if not plural:
        cases.append((rf"^({'|'.join(SINGULAR_US)})(?:es)?$", r"\1"))
    return cases + list(PLURAL if plural else SINGULAR)


def inflect_lower(word: str, plural: bool, documents: bool = False) -> str:
    for pattern, target in _cases(plural, documents):
        if re.search(pattern, word):
            return re.sub(pattern, lambda m: m.expand(target), word, count=1)
    return word


#: Prefix, last hump and what is not a letter after it.
LAST_WORD = r"^(.*?)([A-Z]+|[A-Z]?[a-z]+)([^A-Za-z]*)$"


def _inflect(word: str, plural: bool, documents: bool = False) -> str:
    found = re.match(LAST_WORD, word, re.S)
    if not found:
        return word
    before, last, after = found.groups()
    out = inflect_lower(last.lower(), plural, documents)
    if len(last) > 1 and last.isupper():
        out = out.upper()
    elif last[0].isupper():
        out = out[:1].upper() + out[1:]
    return before + out + after


def pluralize(word: str, documents: bool = False) -> str:
    return _inflect(word, True, documents)


def singularize(word: str) -> str:
    return _inflect(word, False)


def inflect_column(word: Column, plural: bool, documents: bool = False) -> Column:
    """The same for a column: the last word is inflected, its case restored."""
    before, last, after = (F.regexp_extract(word, f"(?s){LAST_WORD}", k) for k in (1, 2, 3))
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731 - evaluates a value once, and keeps the rules out of generated code, which they would outgrow

    def rules(low: Column) -> Column:
        out = low
        for pattern, target in reversed(_cases(plural, documents)):
            out = F.when(low.rlike(pattern), F.regexp_replace(low, pattern, re.sub(r"\\(\d)", r"$\1", target))).otherwise(out)
        return out

    def cases(out: Column) -> Column:
        whole = F.when((F.length(last) > 1) & (last == F.upper(last)), F.upper(out))
        return whole.when(last.rlike("^[A-Z]"), F.concat(F.upper(F.substring(out, 1, 1)), F.substr(out, F.lit(2)))).otherwise(out)

    cased = once(once(F.lower(last), rules), cases)
    return F.when(word.rlike(f"(?s){LAST_WORD}"), F.concat(before, cased, after)).otherwise(word)


def inflect_sql(word: str, plural: bool, documents: bool = False) -> str:
    """DuckDB's SQL for a lower-case word."""
    whens = " ".join(
        f"WHEN regexp_matches({word}, '{p}') THEN regexp_replace({word}, '{p}', '{t}')" for p, t in _cases(plural, documents)
    )
    return f"CASE {whens} ELSE {word} END"
