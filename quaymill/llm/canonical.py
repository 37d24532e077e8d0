"""Mapping free-entered names to the entries of a canonical list."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymill.session import BROADCAST_ROWS, attach, cut

#: Letter changes that leave the meaning.
CHANGES = 2
#: Letters of a token.
GRAM = 2
#: Letters of the list's names, if all were as long as the longest, up to which the list is broadcast.
BROADCAST_LETTERS = 5_000_000
#: Words that make a name another place, with their short forms; the default of ``Wording``.
QUALIFIERS = {
    "north": "north", "n": "north", "south": "south", "s": "south", "east": "east", "e": "east", "west": "west", "w": "west",
    "i": "1", "ii": "2", "iii": "3", "iv": "4", "1": "1", "2": "2", "3": "3", "4": "4", "1st": "1", "2nd": "2", "3rd": "3",
    "market": "market", "mkt": "market", "depot": "depot", "dpt": "depot", "inner": "inner", "outer": "outer",
    "warehouse": "warehouse", "junction": "junction", "jn": "junction", "jct": "junction", "terminus": "terminus", "central": "central",
}
#: Of these a stray blank in a name can make one, so that they may also be a part of the name.
DOUBTFUL = {"n", "s", "e", "w", "i", "ii", "iii", "iv"}
HONORIFICS = {"sri", "shri", "shree", "thiru", "tmt", "smt", "arulmigu", "arignar", "dr"}
GENERIC = {"metro", "station", "stn", "ms"}
#: Only a number of three or more digits is that of a gate or an array; "Gate 3" is a name and an ordinal.
NOTES = re.compile(r"\[\s*\d+\s*\]|\(\s*afc\s*\d+\s*\)|\bafc\s*\d{3,}|#\s*\d+|/\s*g\s*\d+|-?\s*\bgate[\s-]*\d{3,}|,?\s*\barray[\s-]*\d+|\(\s*(?:ug|underground|elevated|at-grade)\s*\)")
MARKS = re.compile(r"[†‡*¹²³⁰-⁹₀-₉®™]")
WORDS = re.compile(r"[^\W_]+(?:[^\W_]|[஀-௿ऀ-෿])*|[ऀ-෿]+")


@dataclass(frozen=True)
class Wording:
    """What words of an entry mean. ``qualifiers``: short forms to the words they stand for; ``doubtful``: those of them that may also be
    part of a name; ``dropped``: words that mean nothing; ``notes``: a pattern of what is noted beside a name, tried on lower case."""

    qualifiers: dict[str, str] = field(default_factory=lambda: QUALIFIERS)
    doubtful: frozenset[str] = frozenset(DOUBTFUL)
    dropped: frozenset[str] = frozenset(HONORIFICS | GENERIC)
    notes: re.Pattern = NOTES


STATION_WORDING = Wording()


def readings(text: str | None, sure: bool = False, most: int = 2, longest: int = 60, wording: Wording = STATION_WORDING) -> list[tuple[str, str, str]]:
    """What an entry may say: ``(name, qualifiers, name without doubtful letters)``, letters only, lower case.

    A single letter may be a direction or ordinal, or a part of the name behind a stray blank: both
    are readings unless ``sure``. A qualifier may also stick to the name's end. A list whose names have at
    most ``most`` qualifiers and ``longest`` letters can't match readings with more, which are left out.
    """
    if text is None:
        return []
    plain = unicodedata.normalize("NFKD", MARKS.sub(" ", text))
    plain = "".join(c for c in plain if not "̀" <= c <= "ͯ").lower()
    known = wording.qualifiers
    words = [w for w in WORDS.findall(wording.notes.sub(" ", plain)) if w not in wording.dropped]
    doubt = [i for i, w in enumerate(words) if w in wording.doubtful and not sure]
    if len(doubt) - most > longest + CHANGES + max(map(len, known), default=0):
        return []
    found = []
    for apart in itertools.chain.from_iterable(itertools.combinations(doubt, k) for k in range(min(len(doubt), most) + 1)):
        joined = {*doubt} - {*apart}
        name = "".join(w for i, w in enumerate(words) if w not in known or i in joined)
        bare = "".join(w for w in words if w not in known)
        marks = [known[w] for i, w in enumerate(words) if w in known and i not in joined]
        found.append((name, " ".join(sorted(marks)), bare))
        if not marks and not sure:
            found += [(name[: -len(q)], known[q], name[: -len(q)]) for q in known if len(q) > 3 and name.endswith(q) and len(name) > len(q) + 2]
    return list(dict.fromkeys(x for x in found if x[0]))


def tokens(name: str) -> list[str]:
    """The letter pairs of ``^name$``, each with its number among its equals: a set that counts repeats."""
    padded, seen = f"^{name}$", Counter()
    out = []
    for i in range(len(padded) - GRAM + 1):
        g = padded[i : i + GRAM]
        seen[g] += 1
        out.append(f"{g}{seen[g]}")
    return out


def short_keys(name: str) -> list[str]:
    """Names of up to three letters may have no pair of letters in common after two changes: all results of up to two deletions."""
    if len(name) > CHANGES * GRAM - 1:
        return []
    return sorted({"~" + "".join(x) for k in range(max(0, len(name) - CHANGES), len(name) + 1) for x in itertools.combinations(name, k)})


def _prefixes(names: DataFrame, rarity: DataFrame, rare_rows: int) -> DataFrame:
    """``names (id, name, ...)`` with their token set, and one row for each rare token of the prefix and its place."""
    t = names.select("id", F.explode("tokens").alias("token")).join(attach(rarity, rare_rows), "token")
    ranked = t.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("r"))
    return ranked.select("id", F.posexplode(F.slice("r", 1, CHANGES * GRAM + 1)).alias("place", "t")).select("id", "place", F.col("t.token").alias("token"))


def map_to_canonical(entries: DataFrame, entry: str, canon: DataFrame, ref: str, names: list[str], wording: Wording = STATION_WORDING) -> DataFrame:
    """``(entry, ref)`` for each distinct non-null value of ``entry``; ref is -1 where none is meant.

    A set-similarity join on letter pairs: tokens are ordered by their rarity over both sides, only
    the rarest ``CHANGES * GRAM + 1`` of each name are joined (two names at most two changes apart
    share one of them), length and place in the prefix rule out pairs that can't share enough, and
    the Jaccard similarity of the rest is computed exactly. Of the pairs that reach what two changes
    leave, those with equal qualifiers and an edit distance of at most ``CHANGES`` are verified; the
    best by distance, similarity and ref is kept. ``wording`` says which words make another place and which mean nothing.

    Nulls give no row; blank entries and those of marks only mean none. Repeated entries count once,
    repeated or null names of the list are allowed; an empty list maps all to -1. Texts of any length
    are taken whole.
    """
    schema = "value string, name string, marks string, bare string, tokens array<string>, short array<string>"

    def read(batches: Iterator[pd.DataFrame], sure: bool, *limits: int) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(v, *r, tokens(r[0]), short_keys(r[0])) for v in b.iloc[:, 0] for r in readings(v, sure, *(limits or (2, 60)), wording)], columns=["value", "name", "marks", "bare", "tokens", "short"])

    values = cut(entries.select(F.col(entry).cast("string").alias("value")).where("value is not null").distinct(), "values")
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = canon.select(F.col(ref).cast("int").alias("ref"), F.explode(F.array(*names)).alias("value")).where("ref is not null and value is not null")
    said = listed.select("value").distinct().mapInPandas(lambda x: read(x, True), schema)
    right = cut(
        listed.join(said, "value").select("ref", "name", "marks", "tokens", "short").distinct().select(F.xxhash64("ref", "name", "marks").alias("id"), "*").withColumn("n", F.size("tokens")),
        "canon",
    )
    limits = right.agg(F.max(F.when(F.col("marks") == "", 0).otherwise(F.size(F.split("marks", " ")))).alias("most"), F.max(F.length("name")).alias("longest")).first()
    most, longest = limits["most"] or 0, limits["longest"] or 0
    left = cut(
        values.repartition(parts, "value").mapInPandas(lambda x: read(x, False, most, longest), schema)
        .select(F.xxhash64("value", "name", "marks").alias("id"), "*")
        .withColumn("n", F.size("tokens")),
        "read",
    )
    rarity = cut(left.select(F.explode("tokens").alias("token")).unionAll(right.select(F.explode("tokens"))).groupBy("token").agg(F.count("*").alias("freq")), "rarity")
    rare_rows = rarity.count()
    # rows as ``attach`` counts them: names of great length count as too many
    rights = right.count()
    rights = rights if rights * longest <= BROADCAST_LETTERS else BROADCAST_ROWS + 1

    def keys(side: DataFrame) -> DataFrame:
        short = side.select("id", F.lit(0).alias("place"), F.explode("short").alias("token"))
        return _prefixes(side, rarity, rare_rows).unionByName(short).join(attach(side.select("id", "n", "marks"), rights if side is right else None), "id")

    a = keys(left).select(F.col("id").alias("a"), F.col("place").alias("pa"), "token", F.col("n").alias("na"), "marks")
    b = keys(right).select(F.col("id").alias("b"), F.col("place").alias("pb"), "token", F.col("n").alias("nb"), "marks")
    need = F.greatest("na", "nb") - CHANGES * GRAM
    pairs = (
        a.join(attach(b, rights * (CHANGES * GRAM + 1)), ["token", "marks"])
        .where(F.abs(F.col("na") - F.col("nb")) <= CHANGES)
        .where((1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1 >= need) | F.col("token").startswith("~"))
        .select("a", "b")
        .distinct()
    )
    sides = pairs.join(left.select(F.col("id").alias("a"), "value", F.col("name").alias("x"), "bare", F.col("tokens").alias("tx")), "a")
    sides = sides.join(attach(right.select(F.col("id").alias("b"), "ref", F.col("name").alias("y"), F.col("tokens").alias("ty")), rights), "b")
    both = F.size(F.array_intersect("tx", "ty"))
    least = F.greatest(F.lit(0), F.greatest(F.size("tx"), F.size("ty")) - CHANGES * GRAM)
    union = F.size("tx") + F.size("ty") - both
    verified = (
        sides.withColumn("jaccard", both / union)
        .where(F.col("jaccard") >= least / (F.size("tx") + F.size("ty") - least) - 1e-9)
        .withColumn("d", F.levenshtein("x", "y", CHANGES))
        # a letter read as a part of the name must belong there: without it the name is further away
        .where((F.col("d") >= 0) & ((F.col("bare") == F.col("x")) | (F.col("d") < F.levenshtein("bare", "y"))))
    )
    best = cut(verified.groupBy("value").agg(F.min(F.struct("d", -F.col("jaccard"), "ref")).alias("m")).select("value", F.col("m.ref").alias("ref")), "best")
    return values.join(attach(best), "value", "left").select(F.col("value").alias(entry), F.coalesce("ref", F.lit(-1)).alias(ref))
