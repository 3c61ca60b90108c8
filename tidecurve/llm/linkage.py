"""Problem 4: linking recordings of two sources without a key, by collective graph linkage.

1. every distinct record is read once (``recordings``), each way it may be
   meant, and gives attributes that few share.  Of the start and the end of a
   title a typing error leaves one whole; each is paired with the version and
   the length, or where a length is missing with a word of the performer;
2. the candidate graph joins records of the two sources that share an
   attribute, unless lengths or the titles' letter pairs already rule them out;
   an edge weighs the summed rarity of what it shares;
3. every edge has a likeness of its own (title, performer, version, length),
   or is none; meta-blocking then drops one that is light beside the heaviest
   of both its ends, unless the titles may be one typing error apart;
4. few are certain by it: where the performer or the length is missing, or two
   errors meet, the edge starts below the threshold and its neighbours decide.
   Support comes from the other records of both performers, as the share of
   them that accepted edges link to each other, and from the rivals of the edge
   at its item.  Accepting edges changes support, so rounds go on until no
   score moves by ``STILL``.

Equal records are one node each and come back by membership at the end, so a
record holding a third of all rows costs no more than any other.  An attribute
that many share is first divided by parts of the performers' names, of which two
performers that may be the same have one in common, and then salted; so the
edges are the same with and without division.

Defined results: a null or blank title or (in the keyed source) performer
belongs to no case; a null length or performer in the other source is no
evidence either way; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidecurve.llm import recordings as R
from tidecurve.llm.hot import salted_join
from tidecurve.shared import cut, drop, tasks

#: Seconds by which lengths of one recording may differ, and the width of a bucket of lengths.
TOLERANCE, WIDTH = 4.0, 8.0
#: Bits of 64 in which the bigram sketches of two titles may differ; one typing error turns over six at most.
SKETCH_APART = 8
#: A word is known if it occurs in this share of all titles and names at least, so there are at most a few times its inverse.
KNOWN_SHARE = 1e-4
#: Two words this common are two words and no typing error, unless performer and length agree.
COMMON = -math.log(5e-4)
#: Records of one attribute from which on it is divided by parts of names, and that then meet in one task.
HOT = 500
#: Parts of the attributes that meet one after another, so that the disk holds one part's exchange at a time.
ROUNDS = 4
PRUNE = 0.4
ACCEPT = 0.78
#: What full support adds to a score and none takes from it; the difference in score at which one rival is told from another.
SUPPORT, RIVAL = 0.2, 0.03
STILL = 0.005


def known_words(texts: DataFrame) -> dict[str, float]:
    """Words in a ``KNOWN_SHARE`` of all rows of ``texts(text)`` at least, with their rarity; size bound by that share."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    counted = cut(texts.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "p4-words")
    total = max(1, texts.count())
    rows = counted.where((F.col("n") >= max(3.0, KNOWN_SHARE * total)) & (F.col("w") != "")).collect()
    drop(counted)
    return {r["w"]: math.log(total / r["n"]) for r in rows}


def _buckets(length: float | None, spread: bool) -> list[int]:
    if length is None or length != length:
        return []
    if not spread:
        return [int(length // WIDTH)]
    return sorted({int((length - TOLERANCE) // WIDTH), int((length + TOLERANCE) // WIDTH)})


def _halves(title: str, keyed: bool) -> set[str]:
    """Start and end of a title; two titles one typing error apart share one of them.

    The letter between them belongs to neither, so neighbours swapped there
    spare the start.  The keyed source halves its own length, the other every
    length it may meet.
    """
    n, out = len(title), set()
    for k in (n,) if keyed else (n - 1, n, n + 1):
        if k > 0:
            out |= {title[: max(0, k // 2 - 1)] + "-", "-" + title[n - (k - k // 2) :]}
    return out


def attributes(reading: R.Reading, length: float | None, keyed: bool, by_name: bool = False) -> set[str]:
    """Attributes of one reading.

    The keyed source gives one bucket of lengths, the other all it may meet.
    ``by_name``: the keyed source has records without length, so the other
    pairs its titles with the performer even where it knows the length.
    """
    near, out = _buckets(length, not keyed), set()
    names = {w for w in reading.artist if len(w) > 1} if keyed or by_name or not near else set()
    if not reading.cut:
        for half in _halves(reading.compact, keyed):
            out |= {f"1|{half}|{reading.version}|{b}" for b in near} | {f"2|{half}|{reading.version}|{a}" for a in names}
        if keyed or (not near and not reading.artist):
            out.add(f"3|{reading.compact}|{reading.version}")
    # a title cut short meets whole ones by its start; two whole ones do not meet there
    for side in {keyed, not keyed} if reading.cut else {not keyed}:
        start = f"{side}|{reading.compact[:4]}|{reading.version}"
        out |= {f"4|{start}|{b}" for b in near} | {f"5|{start}|{a}" for a in names}
    return out


def sketch(reading: R.Reading) -> int | None:
    """64 bits set by the title's letter pairs; none for a title cut short."""
    if reading.cut:
        return None
    title, bits = f"^{reading.compact}$", 0
    for x, y in zip(title, title[1:]):
        bits |= 1 << ((31 * ord(x) + ord(y)) % 64)
    return bits - (1 << 64) if bits >> 63 else bits


@lru_cache(maxsize=50_000)
def _name_parts(artist: tuple[str, ...], lead: tuple[str, ...], keyed: bool) -> list[int]:
    texts = {w for w in (*artist, *lead) if len(w) > 1} | {"".join(artist), "".join(lead)} - {""}
    parts = {p for t in texts for p in (_halves(t, keyed) if len(t) > 3 else {t})}
    return sorted(xxhash.xxh64_intdigest(p) - (1 << 63) for p in parts)


def name_parts(reading: R.Reading, keyed: bool) -> list[int]:
    """Hashes of which performers have one in common wherever ``recordings.same_artist`` may hold; none where nobody is named.

    It asks for a word or a joined name that is equal or, from four letters on, one typing error apart.
    """
    return _name_parts(tuple(reading.artist), tuple(reading.lead), keyed) if reading.artist else []


def _members(df: DataFrame, key: str, title: str, artist: str, length: Column, where: str) -> DataFrame:
    """``(key, node, title, artist, length)``; equal records share the 128 bits of ``node``."""
    own = df.where(where).select(F.col(key).alias("key"), F.col(title).alias("title"), F.col(artist).alias("artist"), length.cast("double").alias("length"))
    node = F.unhex(F.md5(F.concat_ws("\x1f", "title", F.coalesce("artist", F.lit("\x00")), F.coalesce(F.col("length").cast("string"), F.lit("")))))
    return own.withColumn("node", node)


_READ = "view bigint, node binary, length double, compact string, cut boolean, version string, sketch bigint, parts array<bigint>, tokens array<string>, detail string, artist array<string>, lead array<string>, keys array<bigint>"


def _read(nodes: DataFrame, keyed: bool, by_name: bool) -> DataFrame:
    """Every way a node may be read, once: its parts and the hashes of its attributes.  ``view`` numbers the readings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for node, title, artist, length in zip(batch["node"], batch["title"], batch["artist"], batch["length"]):
                for t, a in ((title, artist), (artist, title)) if keyed else ((title, artist),):
                    r = R.read(t, a)
                    keys = [xxhash.xxh64_intdigest(k) - (1 << 63) for k in attributes(r, length, keyed, by_name)]
                    out.append((node, length, r.compact, r.cut, r.version, sketch(r), name_parts(r, keyed), r.tokens, r.detail, r.artist, r.lead, keys))
            names = [f.split()[0] for f in _READ.split(", ")[1:]]
            yield pd.DataFrame(out, columns=names).astype({"sketch": "Int64"})

    spread = nodes.repartition(tasks(nodes.sparkSession), "node")
    read = spread.mapInPandas(run, _READ.split(", ", 1)[1])
    return cut(read.withColumn("view", F.monotonically_increasing_id()), f"p4-read-{keyed}", compression="zstd")


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(view_a, view_b, weight)``: readings that share an attribute, unless their lengths or titles rule them out."""

    def rows(df: DataFrame, side: str) -> DataFrame:
        size = F.when(~F.col("cut"), F.length("compact"))
        return df.withColumn("size", size).select(F.explode("keys").alias("key"), *[F.col(c).alias(f"{c}_{side}") for c in ("view", "length", "sketch", "size")])

    left, right = rows(a, "a"), rows(b, "b")
    shared = cut(left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(right.select("key").distinct(), "key", "left_semi"), "p4-shared")
    weight = F.log(1 + F.lit(float(max(1, a.count()))) / F.col("n")).cast("float")
    rare = shared.where(F.col("n") <= HOT).select("key", weight.alias("weight"))
    hot = cut(shared.where(F.col("n") > HOT).select("key", weight.alias("weight")), "p4-hot")
    gap = F.abs(F.col("length_a") - F.col("length_b"))
    apart = F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("sketch_b")))
    # whole titles one error apart differ by one letter in length at most
    fits = F.coalesce(gap <= TOLERANCE, F.lit(True)) & F.coalesce((apart <= SKETCH_APART) & (F.abs(F.col("size_a") - F.col("size_b")) <= 1), F.lit(True))
    summed = lambda df, label: cut(df.groupBy("view_a", "view_b").agg(F.sum("weight").alias("weight")), label)
    met = [] if hot.isEmpty() else [summed(_met_hot(a, b, left, right, hot).where(fits), "p4-hot-met")]
    for k in range(ROUNDS):
        of = lambda df: df.where(F.pmod("key", F.lit(ROUNDS)) == k)
        met.append(summed(of(right).join(of(left).join(of(rare), "key"), "key").where(fits), "p4-met"))
    found = summed(reduce(DataFrame.unionByName, met), "p4-candidates")
    drop(shared, hot, *met)
    return found


def _met_hot(a: DataFrame, b: DataFrame, left: DataFrame, right: DataFrame, hot: DataFrame) -> DataFrame:
    """Readings that share a hot attribute, each pair once for it: those with a part of a name in common, and whoever names nobody."""
    own_a = cut(left.join(hot, "key").join(a.select(F.col("view").alias("view_a"), F.col("parts").alias("parts_a")), "view_a"), "p4-hot-a")
    own_b = cut(right.join(hot.select("key"), "key", "left_semi").join(b.select(F.col("view").alias("view_b"), F.col("parts").alias("parts_b")), "view_b"), "p4-hot-b")
    named = lambda df, side: df.where(F.size(f"parts_{side}") > 0)
    nameless = lambda df, side: df.where(F.size(f"parts_{side}") == 0).drop(f"parts_{side}")
    whole_a, whole_b = own_a.drop("parts_a"), own_b.drop("parts_b")
    met = salted_join(nameless(own_b, "b"), whole_a, "key", "view_a", HOT)
    met = met.unionByName(salted_join(named(own_b, "b").drop("parts_b"), nameless(own_a, "a"), "key", "view_a", HOT))
    divided = lambda df, side: named(df, side).withColumn("part", F.explode(f"parts_{side}")).withColumn("key", F.xxhash64("key", "part"))
    both = salted_join(divided(own_b, "b").drop("part"), divided(own_a, "a"), "key", "view_a", HOT)
    # those with several parts in common meet at the least of them
    least = F.array_min(F.array_intersect("parts_a", "parts_b")) == F.col("part")
    return met.unionByName(both.where(least).drop("parts_a", "parts_b", "part"))


def _near(x: Column, y: Column) -> Column:
    """``recordings.near`` of two words: one edit at most, or two letters that changed places."""
    apart = F.levenshtein(x, y, 2)
    swapped = (apart == 2) & (F.length(x) == F.length(y)) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, "")))
    return (apart == 0) | (apart == 1) | swapped


def _likeness(pairs: DataFrame, rarity: dict[str, float]) -> DataFrame:
    """Score every edge on its own evidence; ``x`` and ``y`` name the performers as spelt."""
    spread = pairs.sparkSession.sparkContext.broadcast(rarity)
    kept = ("compact", "cut", "version", "detail", "tokens", "artist", "lead")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = spread.value
        known = lambda w: words.get(w, 99.0) < COMMON
        for batch in batches:
            readings = []
            for side in "ab":
                parts = zip(*(batch[f"{c}_{side}"] for c in kept))
                readings.append([R.Reading(list(k), c, short, v, d, list(n), list(l), False) for c, short, v, d, k, n, l in parts])
            out = []
            for at, (na, nb, x, y, la, lb) in enumerate(zip(batch["node_a"], batch["node_b"], *readings, batch["length_a"], batch["length_b"])):
                gap = None if la is None or lb is None or la != la or lb != lb else abs(la - lb)
                edge = edge_score(x, y, gap, known)
                if edge:
                    out.append((at, na, nb, *edge))
            found = pd.DataFrame(out, columns=["at", "node_a", "node_b", "own", "named", "x", "y"])
            rows = batch[["view_a", "view_b", "weight", "whole"]].iloc[found.pop("at").astype(int)].reset_index(drop=True)
            yield pd.concat([rows, found], axis=1)

    return pairs.mapInPandas(run, "view_a bigint, view_b bigint, weight double, whole boolean, node_a binary, node_b binary, own double, named double, x string, y string")


def _pruned(scored: DataFrame) -> DataFrame:
    """``scored`` without edges of cut titles that are light beside the heaviest of both their ends."""
    short = scored.where(~F.col("whole"))
    for v in ("view_a", "view_b"):
        heaviest = scored.groupBy(v).agg(F.max("weight").alias(f"most_{v}"))
        short = short.join(heaviest, v)
    kept = short.where(F.col("weight") >= PRUNE * F.least("most_view_a", "most_view_b"))
    return scored.where("whole").unionByName(kept.select(scored.columns))


def edge_score(x: R.Reading, y: R.Reading, gap: float | None, known) -> tuple[float, float | None, str, str] | None:
    """Likeness in 0..1 of two readings whose lengths differ by ``gap`` seconds (None: unknown), that of their
    performers (None: nobody named) and both spellings of them; None for no edge."""
    if not R.version_fits(x, y) or (gap is not None and gap > TOLERANCE):
        return None
    title = R.title_likeness(x, y, known)
    if not title:
        return None
    artist, spelt_x, spelt_y = R.same_artist(x, y)
    if artist == 0.0 or (title == 0.5 and (gap is None or (artist or 0) < 0.95)):
        return None
    own = 0.45 * title + (0.33 * artist if artist is not None else 0.1) + (0.22 * (1 - gap / 16) if gap is not None else 0.05)
    return own, artist, spelt_x, spelt_y


def link(
    keyed: DataFrame, other: DataFrame, *, key: str, title: str, artist: str, length: Column,
    other_key: str, other_title: str, other_artist: str, other_length: Column,
) -> DataFrame:
    """``(key, other_key, confidence)`` of the matching rows.  Lengths are columns in seconds."""
    edges, a, b = graph(
        keyed, other, key=key, title=title, artist=artist, length=length,
        other_key=other_key, other_title=other_title, other_artist=other_artist, other_length=other_length)
    members_a = a.select(F.col("node").alias("node_a"), F.col("key").alias(key))
    members_b = b.select(F.col("node").alias("node_b"), F.col("key").alias(other_key))
    final = edges.where(F.col("score") >= ACCEPT)
    return final.join(members_a, "node_a").join(members_b, "node_b").select(key, other_key, F.round(F.least("score", F.lit(0.999)), 4).alias("confidence"))


def graph(
    keyed: DataFrame, other: DataFrame, *, key: str, title: str, artist: str, length: Column,
    other_key: str, other_title: str, other_artist: str, other_length: Column,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every edge ``(node_a, node_b, own, score)`` and the members ``(key, node, ...)`` of both sources' nodes."""
    a = _members(keyed, key, title, artist, length, f"trim(`{title}`) != '' and trim(`{artist}`) != ''")
    b = _members(other, other_key, other_title, other_artist, other_length, f"trim(`{other_title}`) != ''")
    rarity = known_words(a.select(F.concat_ws(" ", "title", "artist").alias("text")).unionAll(b.select(F.concat_ws(" ", "title", "artist").alias("text"))))
    first = [F.first(c).alias(c) for c in ("title", "artist", "length")]
    nodes_a = cut(a.groupBy("node").agg(*first), "p4-a")
    by_name = not nodes_a.where("length is null or isnan(length)").isEmpty()
    read_a = _read(nodes_a, True, by_name)
    drop(nodes_a)
    read_b = _read(b.groupBy("node").agg(*first), False, by_name)
    found = candidates(read_a, read_b)
    of = lambda df, side, *columns: df.select(*[F.col(c).alias(f"{c}_{side}") for c in ("view", *columns)])
    # titles are compared before the rest of the readings is fetched
    titles = found.join(of(read_a, "a", "compact", "cut"), "view_a").join(of(read_b, "b", "compact", "cut"), "view_b")
    whole = ~F.col("cut_a") & ~F.col("cut_b")
    titled = cut(titles.where(~whole | _near(F.col("compact_a"), F.col("compact_b"))).select("view_a", "view_b", "weight", whole.alias("whole")), "p4-titled")
    drop(found)
    rest = ("node", "length", "compact", "cut", "version", "detail", "tokens", "artist", "lead")
    scored = cut(_likeness(titled.join(of(read_a, "a", *rest), "view_a").join(of(read_b, "b", *rest), "view_b"), rarity), "p4-scored")
    drop(titled, read_a, read_b)
    # of a record's readings the best counts
    best = F.max(F.struct("own", "named", "x", "y"))
    edges = cut(_pruned(scored).groupBy("node_a", "node_b").agg(best.alias("e")).select("node_a", "node_b", "e.*"), "p4-edges")
    drop(scored)
    return propagate(edges), a, b


def propagate(scored: DataFrame) -> DataFrame:
    """Every edge with its final ``score``: own likeness refined by its neighbours', until stable.

    ``together``: of the items that accepted edges give performer x, and of
    those that they give performer y, the share which leads to the other, this
    edge left out.  A spelling that is alike to the one the other side mostly
    leads to, or that this one is alike to, counts as that.  The likeness of the spellings stands for two
    records on each side beside the others; equal ones have one half at least.
    ``alone``: how far the edge lies before the best edge of its item that
    leads to another performer, one half at a tie; 1 without a rival.
    An edge between named performers is supported by the first, one whose item
    names nobody by the second.  From the third round on steps are halved, so
    that edges which turn each other over come to rest.
    """
    score, rounds, before = scored.withColumn("score", F.col("own")), 0, scored
    while True:
        rounds += 1
        step = 0.5 ** max(0, rounds - 2)
        named, nameless = score.where("named is not null"), score.where("named is null")
        refined = _together(named).unionByName(_alone(nameless))
        target = F.col("own") + SUPPORT * (2 * F.col("support") - 1)
        stepped = refined.select(*scored.columns, F.col("score").alias("before"), ((1 - step) * F.col("score") + step * target).alias("score"))
        after = cut(stepped, "p4-round")
        moved = after.agg(F.max(F.abs(F.col("score") - F.col("before")))).collect()[0][0]
        drop(before)
        score, before = after.drop("before"), after
        if moved is None or moved < STILL:
            return score


def _together(named: DataFrame) -> DataFrame:
    """Edges with their ``support`` by the other records of both performers."""
    links = named.where(F.col("score") >= ACCEPT).select("x", "y", "node_b").distinct()
    counted = links.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_xy"))
    most = lambda c: F.max_by(c, F.struct("n_xy", c))
    of_x = counted.groupBy("x").agg(F.sum("n_xy").alias("n_x"), most("y").alias("main_y"), F.max("n_xy").alias("n_main_y"))
    of_y = counted.groupBy("y").agg(most("x").alias("main_x"), F.max("n_xy").alias("n_main_x")).join(links.groupBy("y").agg(F.countDistinct("node_b").alias("n_y")), "y")
    # what holds for a pair of performers is worked out once for all its edges
    pairs = named.select("x", "y").distinct().join(counted, ["x", "y"], "left").join(of_x, "x", "left").join(of_y, "y", "left")
    meant = lambda own, main, far: F.when((F.col(own) != F.col(main)) & (_alike(F.col(own), F.col(main)) | _alike(F.col(far), F.col(main))), F.col(f"n_{main}"))
    pairs = pairs.select("x", "y", "n_xy", "n_x", "n_y", meant("x", "main_x", "y").alias("like_x"), meant("y", "main_y", "x").alias("like_y"))
    left_out = lambda c: F.greatest(F.coalesce(c, F.lit(0)) - (F.col("score") >= ACCEPT).cast("int"), F.lit(0))
    both = F.greatest(left_out("n_xy"), F.col("like_x"), F.col("like_y"))
    by_x, by_y = F.greatest(left_out("n_x"), F.col("like_x")), F.greatest(left_out("n_y"), F.col("like_y"))
    share = (2 * both + 4 * (0.25 + 0.6 * F.col("named"))) / (by_x + by_y + 4)
    support = F.least(F.greatest(share, F.when(F.col("x") == F.col("y"), 0.5)), F.lit(1.0))
    return named.join(pairs, ["x", "y"]).select(*named.columns, support.alias("support"))


def _alone(nameless: DataFrame) -> DataFrame:
    """Edges of items that name nobody with their ``support`` by how far they lie before their rivals."""
    # an item's best edge for each performer, and the best for another than the first
    per = nameless.groupBy("node_b", "x").agg(F.max("score").alias("s"))
    top = per.groupBy("node_b").agg(F.max_by("x", F.struct("s", "x")).alias("top"), F.max("s").alias("first"))
    other = per.join(top, "node_b").where(~_alike(F.col("x"), F.col("top"))).groupBy("node_b").agg(F.max("s").alias("second"))
    rival = F.when(_alike(F.col("x"), F.col("top")), F.col("second")).otherwise(F.col("first"))
    support = F.coalesce(1 / (1 + F.exp((rival - F.col("score")) / RIVAL)), F.lit(1.0))
    return nameless.join(top, "node_b").join(other, "node_b", "left").select(*nameless.columns, support.alias("support"))


def _alike(x: Column, y: Column) -> Column:
    """Two spellings of one performer."""
    return (x == y) | ((F.length(x) > 5) & _near(x, y))
