"""Normalising and parsing of answers, questions, prompts and paths, as Column expressions where they can be."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from visgauge.functions.vocabulary import CATEGORY_ALIASES, COCO_CATEGORIES, RELATION_PHRASES


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case, `_` as `-`, anything but a-z, 0-9, `-` and white space as a blank, single blanks."""
    return _squeezed(F.regexp_replace(F.translate(F.lower(c), "_", "-"), r"[^a-z0-9\s-]", " "))


def canonical_text(c: Column) -> Column:
    """Lower case, `_` as a blank, single blanks; null is empty."""
    return _squeezed(F.translate(F.lower(F.coalesce(c, F.lit(""))), "_", " "))


def parse_flag(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes"), F.lit(False))


def parse_yes_no(c: Column) -> Column:
    """yes or no if just one of the words occurs, else null."""
    found = F.array_distinct(F.regexp_extract_all(normalize_text(c), F.lit(r"\b(yes|no)\b"), F.lit(1)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def parse_relation(c: Column, phrases: dict[str, list[str]] | None = None) -> Column:
    """The one relation of which a phrase occurs; null if none or several do."""
    text = normalize_text(c)
    hits = [F.when(text.rlike(r"\b(?:" + "|".join(map(re.escape, p)) + r")\b"), F.lit(name)) for name, p in (phrases or RELATION_PHRASES).items()]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def official_answer(c: Column) -> Column:
    """no if a word of the first sentence is No, no or not, and yes in any other case."""
    words = F.split(F.regexp_replace(F.substring_index(c, ".", 1), ",", ""), " ")
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, ("No", "no", "not")))), F.lit("no")).otherwise(F.lit("yes"))


def outcome(predicted: Column, target: Column) -> Column:
    """TP, FN, FP or TN of a yes or no answer."""
    yes = predicted == "yes"
    return F.when(target == "yes", F.when(yes, "TP").otherwise("FN")).otherwise(F.when(yes, "FP").otherwise("TN"))


def grounding_prompt(categories: Column) -> Column:
    """Distinct trimmed labels, sorted and joined by `. `, with a full stop; empty if there are none."""
    labels = F.array_sort(F.array_distinct(F.filter(F.transform(categories, lambda x: F.trim(x)), lambda x: x != "")))
    return F.when(F.size(labels) > 0, F.concat(F.array_join(labels, ". "), F.lit("."))).otherwise(F.lit(""))


def normalize_prompt(c: Column) -> Column:
    """Phrases between full stops or semicolons, in lower case, joined again; an error if none is left."""
    phrases = F.filter(F.transform(F.split(c, "[.;]+"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.when(F.size(phrases) > 0, F.concat(F.array_join(phrases, ". "), F.lit("."))).otherwise(F.raise_error(F.lit("a grounding prompt needs a phrase")))


def evidence_targets(phrases: Column, limit: int, most: int = 80) -> Column:
    """The first distinct phrases, in lower case and without marks around them; empty and long ones go."""
    clean = F.transform(phrases, lambda x: F.regexp_replace(_squeezed(F.lower(x)), r"^[\s.,;:!?\"'`]+|[\s.,;:!?\"'`]+$", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: (x != "") & (F.length(x) <= most))), 1, limit)


def manual_targets(c: Column, limit: int) -> Column:
    return evidence_targets(F.split(c, r"[,;\n.]+"), limit)


def has_open_ending(c: Column) -> Column:
    """Whether a text that is not blank ends without a closing mark."""
    end = F.rtrim(c)
    return (end != "") & ~end.rlike(r"[.!?)}\]]$")


def object_phrase(question: Column) -> Column:
    """The object of `Is there a X in the image?`, or null."""
    found = F.regexp_extract(F.trim(question), r"(?i)^is there (?:a|an|any) (.+?) in the image\?$", 1)
    return F.when(found != "", F.lower(found))


def question_entities(question: Column, task: Column) -> Column:
    """The objects that a question asks about: one for existence, two for a relation, none for a listing."""
    one = object_phrase(question)
    pattern = r"(?i)^where is the (.+?) relative to the (.+?)\?$"
    pair = F.array(*[F.lower(F.regexp_extract(F.trim(question), pattern, k)) for k in (1, 2)])
    return F.when(task == "object_existence", F.array_compact(F.array(one))).when(task == "spatial_relation", F.filter(pair, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def slug(c: Column) -> Column:
    return F.translate(F.lower(c), " ", "-")


def safe_label(c: Column) -> Column:
    """A part of a file name, `object` if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("object"))


def threshold_slug(x: Column) -> Column:
    """0.3 as 0p30."""
    return F.translate(F.format_string("%.2f", x.cast("double")), ".", "p")


def with_article(c: Column) -> Column:
    return F.concat(F.when(F.lower(F.substring(c, 1, 1)).isin(*"aeiou"), F.lit("an ")).otherwise(F.lit("a ")), c)


def pluralize(c: Column) -> Column:
    """A phrase with its last word in the plural, by the rules -es, -ies and -s; words stand one blank apart. A phrase
    without words stays as it is."""
    words = _squeezed(c)
    return (
        F.when(words == "", c)
        .when(words.rlike(r"(s|x|z|ch|sh)$"), F.concat(words, F.lit("es")))
        .when(words.rlike(r"[^aeiou ]y$"), F.regexp_replace(words, "y$", "ies"))
        .otherwise(F.concat(words, F.lit("s")))
    )


def candidate_key(query_key: Column, index: Column) -> Column:
    return F.format_string("%s__annotation-%03d", query_key, index)


def portable_path(path: Column, root: str) -> Column:
    """A path of either system, relative to the folder of root's name wherever that stands in it, so that paths that were
    written on another machine become relative as well; other paths stay as they are, with slashes."""
    posix = F.translate(path, "\\", "/")
    marker = "/" + root.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1] + "/"
    inside = F.locate(marker, posix)
    return F.when(inside > 0, F.regexp_replace(F.substr(posix, inside + len(marker)), "^/+", "")).otherwise(posix)


def category_pattern(vocabulary: Sequence[str], aliases: dict[str, list[str]]) -> tuple[re.Pattern[str], dict[str, str]]:
    """One pattern of all names, longest first, and the category of each name; a name may have a plural s."""
    of: dict[str, str] = {}
    for category in dict.fromkeys(vocabulary):
        for name in aliases.get(category, [category]):
            plain = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s-]", " ", name.lower().replace("_", "-"))).strip()
            for form in (plain, "" if plain.endswith("s") else f"{plain}s"):
                if form:
                    of.setdefault(form, category)
    names = sorted(of, key=lambda n: (-len(n), n))
    return re.compile(rf"\b(?=({'|'.join(map(re.escape, names)) or '(?!)'})\b)"), of


def extract_categories(c: Column, vocabulary: Sequence[str] = COCO_CATEGORIES, aliases: dict[str, list[str]] | None = None) -> Column:
    """The categories named in a text, sorted: of overlapping names the longest counts, then the first."""
    pattern, of = category_pattern(vocabulary, CATEGORY_ALIASES if aliases is None else aliases)

    def longest(text: str | None) -> list[str] | None:
        if text is None:
            return None
        spans = []
        for m in pattern.finditer(text):  # the longest name that begins here, and the shorter ones that begin it
            spans += [(m.start(), m.start() + e.end(), of[m[1][: e.end()]]) for e in re.finditer(r"\b", m[1]) if m[1][: e.end()] in of]
        spans.sort(key=lambda s: (s[0] - s[1], s[0]))
        taken: list[tuple[int, int, str]] = []
        for span in spans:
            if all(span[1] <= t[0] or span[0] >= t[1] for t in taken):
                taken.append(span)
        return sorted({t[2] for t in taken})

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(longest)

    return find(normalize_text(c))


def recover_json(c: Column, opening: str = "{") -> Column:
    """struct(json, source): the first JSON object (or array, for `[`) of a text that is one (direct), holds one in a
    fenced block (fenced) or anywhere (embedded); null and `none` if there is none, or if the text is nested more deeply
    than the parser goes (some thousand levels)."""
    kind = dict if opening == "{" else list

    def attempt(text: str, source: str) -> tuple[str, str] | None:
        try:
            value = json.loads(text)
        except ValueError:
            return None
        return (json.dumps(value, sort_keys=True), source) if isinstance(value, kind) else None

    def recover(text: str | None) -> tuple[str | None, str]:
        text = (text or "").strip()
        found = attempt(text, "direct")
        fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S | re.I)
        if found is None and fenced:
            found = attempt(fenced[1].strip(), "fenced")
        at = text.find(opening)
        while found is None and at >= 0:
            try:
                found = json.dumps(json.JSONDecoder().raw_decode(text, at)[0], sort_keys=True), "embedded"
            except ValueError:
                at = text.find(opening, at + 1)
        return found or (None, "none")

    def bounded(text: str | None) -> tuple[str | None, str]:
        try:
            return recover(text)
        except RecursionError:
            return None, "none"

    @F.pandas_udf("json string, source string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bounded(t) for t in texts], columns=["json", "source"])

    return run(c)
