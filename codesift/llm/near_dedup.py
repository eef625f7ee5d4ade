"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document is the set of its distinct five-word shingles.  Equal sets are collapsed first.
SuperMinHash gives every element one random rank per slot, and the ranks of an element form
a permutation, so slots are negatively correlated and signatures vary less than with
independent hashes; an element stops as soon as its ranks can lower no slot.  Signatures
are cut into bands; documents that agree in a band are candidates.

Candidates are tested without listing the pairs of a band's group.  First every member is
tested against the group's first document, on the full sets.  Only groups whose members
are then in different components are taken up again: in blocks, pairs across components
whose signatures are not too far apart are tested until the components are one.  With ``BANDS`` bands of ``ROWS`` slots a
pair at the threshold of 0.75 is missed with a probability below 3e-7, and a pair at the
threshold is dropped by its signature (less than ``LEAST_ALIKE``) with one below 1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.batches import bound_batches, give_back
from codesift.llm.components import components
from codesift.llm.joins import BROADCAST_BYTES, keyed_join
from codesift.llm.words import constants, mix, word_hashes
from codesift.operators.ranking import number_within
from codesift.session import durable

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 40, 4
SLOTS = BANDS * ROWS
#: Signatures of candidates across components agree in so many slots at least.
LEAST_ALIKE = 0.56
#: Members of a band's group, and their shingles, in a block (about); members of one hub in a task's stretch.
BLOCK, BLOCK_SHINGLES, SALT_ROWS = 512, 1_000_000, 512
_BYTES, _ELEMENTS = 1 << 21, 100_000
_STEPS = np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_KEYS, _BAND_KEYS = constants(SHINGLE, 1), constants(ROWS, 2)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words, _, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    whole = words[: max(0, len(words) - SHINGLE + 1)] * _KEYS[0]
    for i in range(1, SHINGLE):
        whole = whole + words[i : i + len(whole)] * _KEYS[i]
    whole = mix(whole)
    sets = []
    for end, n in zip(ends, counts, strict=True):
        if n >= SHINGLE:
            sets.append(np.unique(whole[end - n : end - SHINGLE + 1]))
        elif n:
            sets.append(mix(np.array([(words[end - n : end] * _KEYS[:n]).sum() + np.uint64(n)])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def superminhash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures (sets x SLOTS): step in the upper 32 bits, random fraction in the lower; all ones for empty sets."""
    out = np.full((len(sets), SLOTS), ~np.uint64(0))
    flat = out.reshape(-1)
    x = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    ranks = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(x), 1))
    low = np.uint64(0xFFFFFFFF)
    for step in range(SLOTS):
        if not len(x):
            break
        draw = mix(x + _STEPS[step])
        at = np.arange(len(x))
        other = step + ((draw & low) * np.uint64(SLOTS - step) >> np.uint64(32)).astype(np.int64)
        slot = ranks[at, other]
        ranks[at, other] = ranks[:, step]
        np.minimum.at(flat, owner * SLOTS + slot, (np.uint64(step) << np.uint64(32)) | (draw >> np.uint64(32)))
        # A set is done when its next ranks exceed all it has.
        going = out.max(axis=1) >= np.uint64(step + 1) << np.uint64(32)
        keep = going[owner]
        if not keep.all():
            x, owner, ranks = x[keep], owner[keep], ranks[keep]
    return out


def _parts(sizes: list[int], most: int) -> Iterator[slice]:
    begin = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total > most:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    yield slice(begin, len(sizes))


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = list(batch["text"])
        for part in _parts([len(t) for t in texts], _BYTES):
            sets = shingle_sets(texts[part])
            signatures = np.concatenate([superminhash(sets[p]) for p in _parts([len(s) for s in sets], _ELEMENTS)])
            bands = mix((signatures.reshape(len(sets), BANDS, ROWS) * _BAND_KEYS).sum(axis=2)).view(np.int64)
            coarse = (mix(signatures) & np.uint64(0xFF)).astype(np.uint8)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].iloc[part].to_numpy(),
                    "mark": batch["mark"].iloc[part].to_numpy(),
                    "n": [len(s) for s in sets],
                    "set_id": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                    "bands": list(bands),
                    "signature": [s.tobytes() for s in coarse],
                }
            )
    give_back()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), n (set size), set_id, bands (keys) and signature (a byte per slot) of ``docs(doc_id, text)``."""
    bound_batches(docs.sparkSession)
    return _marked(docs).mapInPandas(_signed, "doc_id long, mark long, n long, set_id binary, bands array<long>, signature binary")


def _marked(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"))


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between a hub and the members that follow it in the stream."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        links = []
        sets = shingle_sets(list(batch["text"]))
        for place, doc, is_hub, found in zip(zip(batch["hub"], batch["salt"], strict=True), batch["doc_id"], batch["is_hub"], sets, strict=True):
            if is_hub:
                hub, own = place, found
                continue
            if hub != place:
                raise ValueError("a member came without its hub")
            if _linked(own, found):
                links.append((hub[0], doc))
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= PERCENT * (len(a) + len(b) - common)


def _with_texts(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """The kept table ``places(doc_id, ...)``, rows of at most ``width`` bytes, with the documents' texts.

    A document may have several places; their list is broadcast if its size allows it.
    """
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    small = places.count() * width <= BROADCAST_BYTES
    return texts.join(F.broadcast(places) if small else places, "doc_id")


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs(hub, doc_id)`` (kept, distinct) that are links on the full sets, as ``(a, b)``.

    The texts of a hub's members go to as many tasks as they fill, the hub's with them,
    and are read as a stream: no task holds more than a hub and a batch.
    """
    per_hub = durable(pairs.groupBy("hub").agg(F.count("*").alias("rows")))
    salts = F.ceil(F.col("rows") / SALT_ROWS).cast("int").alias("salts")
    members = keyed_join(pairs, per_hub.select("hub", salts, "rows"), ["hub"], "inner", 32, ["doc_id"])
    members = durable(members.select("hub", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), "doc_id"))
    hubs = members.groupBy("hub", "salt").agg(F.lit(True).alias("is_hub")).withColumn("doc_id", F.col("hub"))
    wanted = durable(members.withColumn("is_hub", F.lit(False)).unionByName(hubs))
    placed = _with_texts(docs, wanted, 32).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("is_hub").desc())
    return placed.select("hub", "salt", "doc_id", "is_hub", "text").mapInPandas(_verified, "a long, b long")


_GROUP = ["band", "key", "bi", "bj"]


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups of rows that follow one another in the stream."""
    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        change = (batch[_GROUP] != batch[_GROUP].shift()).any(axis=1).to_numpy()
        starts = np.append(np.flatnonzero(change), len(batch))
        for begin, end in zip(starts[:-2], starts[1:-1], strict=True):
            yield batch.iloc[begin:end]
        held = batch.iloc[starts[-2] :]
    if held is not None:
        yield held


def _candidates(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Rows and their partners across components: like signatures and sizes, and no common band before this one."""
    ids, comp, n, block = (group[c].to_numpy() for c in ("doc_id", "component", "n", "block"))
    band, bi, bj = group["band"].iat[0], group["bi"].iat[0], group["bj"].iat[0]
    rows = np.stack([np.frombuffer(s, np.uint8) for s in group["signature"]])
    bands = np.stack([np.asarray(x, np.int64) for x in group["bands"]])
    right = np.flatnonzero(block == bj)
    for i in np.flatnonzero(block == bi):
        other = right[ids[right] > ids[i]] if bi == bj else right
        other = other[(comp[other] != comp[i]) & (100 * np.minimum(n[other], n[i]) >= PERCENT * np.maximum(n[other], n[i]))]
        alike = (rows[other] == rows[i]).mean(axis=1)
        near = alike >= LEAST_ALIKE
        other, alike = other[near], alike[near]
        first = (bands[other] == bands[i]).argmax(axis=1) == band
        if first.any():
            yield i, other[first][np.argsort(-alike[first], kind="stable")]


def _wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows that have a partner."""
    found = []
    for group in _groups(batches):
        if len(group) > 1 and (rows := {int(x) for i, other in _candidates(group) for x in (i, *other)}):
            found.append(group.iloc[sorted(rows)])
        if sum(map(len, found)) > BLOCK:
            yield pd.concat(found)
            found = []
    if found:
        yield pd.concat(found)


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links on the full sets between components that no earlier link of the group has joined."""
    for group in _groups(batches):
        sets, up = shingle_sets(list(group["text"])), {c: c for c in group["component"]}
        ids, comp = group["doc_id"].to_numpy(), group["component"].to_numpy()

        def root(c: int, up: dict[int, int] = up) -> int:
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        links = []
        for i, others in _candidates(group) if len(group) > 1 else ():
            for o in others:
                x, y = root(comp[i]), root(comp[o])
                if x != y and _linked(sets[i], sets[o]):
                    up[max(x, y)] = min(x, y)
                    links.append((min(ids[i], ids[o]), max(ids[i], ids[o])))
        if links:
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def across(docs: DataFrame, members: DataFrame, parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links between components whose documents meet in a band.

    ``members(band, key, doc_id, n)``; ``parts(id, component)``; ``chosen`` has signatures.
    Members of a band's group are dealt into blocks, those of its largest component apart
    from the others, and every two blocks meet in one place unless both are of the former, first with their signatures, then, those that have a partner, with their texts;
    only links come out.
    """
    placed = keyed_join(members, parts.withColumnsRenamed({"id": "doc_id"}).withColumn("rows", F.lit(BANDS)), ["doc_id"], "left", 32, ["band"])
    placed = durable(placed.select("band", "key", "doc_id", "n", F.coalesce("component", "doc_id").alias("component")))
    # The largest component of a group need not meet itself.
    shares = placed.groupBy("band", "key", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    mixed = shares.groupBy("band", "key").agg(
        F.max_by("component", F.struct("rows", "component")).alias("main"),
        F.max("rows").alias("main_rows"), F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.count("*").alias("parts"),
    )
    per_row = F.greatest(F.lit(1.0) / BLOCK, F.col("total") / F.col("rows") / BLOCK_SHINGLES)
    first, others = F.ceil(F.col("main_rows") * per_row).cast("int"), F.ceil((F.col("rows") - F.col("main_rows")) * per_row).cast("int")
    mixed = durable(mixed.where("parts > 1").select("band", "key", "main", first.alias("first"), others.alias("others"), "rows"))
    rest = keyed_join(placed, mixed, ["band", "key"], "inner", 64, ["doc_id"]).drop("rows")
    is_main, draw, until = F.col("component") == F.col("main"), F.xxhash64("doc_id"), F.col("first") + F.col("others") - 1
    block = F.when(is_main, F.pmod(draw, F.col("first"))).otherwise(F.col("first") + F.pmod(draw, F.col("others"))).cast("int")
    other = F.explode(F.sequence(F.when(is_main, F.col("first")).otherwise(0), until)).alias("_o")
    rest = rest.withColumn("block", block).select("*", other)
    rest = rest.withColumns({"bi": F.least("block", "_o"), "bj": F.greatest("block", "_o")})
    columns = ["band", "key", "bi", "bj", "block", "doc_id", "n", "component"]
    rest = rest.join(chosen.select("doc_id", "signature", "bands"), "doc_id").select(*columns, "signature", "bands")
    wanted = rest.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInPandas(_wanted, rest.schema)
    texts = _with_texts(docs, durable(wanted), 600).select(*columns, "signature", "bands", "text")
    return texts.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInPandas(_across, "a long, b long")


def _named_sets(docs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct sets, each with a number of its own, and their texts under these numbers.

    ``(set_id, sid, doc_id, mark, rows)`` and ``(doc_id, text)``, where doc_id is the number.
    A set's number is its first doc_id.  Where a doc_id occurs with several texts it is a
    number above all doc_ids, so that each of the texts is compared.
    """
    rows = signed.where(F.col("doc_id").isNotNull())
    sets = rows.where("n > 0").groupBy("set_id").agg(F.min(F.struct("doc_id", "mark")).alias("f"), F.count("*").alias("rows"))
    sets = durable(sets.select("set_id", "f.doc_id", "f.mark", "rows"))
    several = rows.groupBy("doc_id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
    several = durable(several.select("doc_id", "rows", F.lit(True).alias("several")))
    texts = _marked(docs).where(F.col("doc_id").isNotNull())
    if several.isEmpty():
        return sets.withColumn("sid", F.col("doc_id")), texts.select("doc_id", "text")
    above = rows.agg(F.max("doc_id")).first()[0]
    again = sets.join(several.select("doc_id"), "doc_id", "left_semi").withColumn("_all", F.lit(0))
    again = number_within(again, "_all", [F.col("set_id")], "sid")
    again = durable(again.select("set_id", "doc_id", "mark", "rows", (F.col("sid") + above).alias("sid")))
    sets = durable(sets.join(several.select("doc_id"), "doc_id", "left_anti").withColumn("sid", F.col("doc_id")).unionByName(again))
    texts = keyed_join(texts, several, ["doc_id"], "left", 32, ["mark"]).drop("rows")
    texts = keyed_join(texts, again.select("doc_id", "mark", "sid", "rows"), ["doc_id", "mark"], "left", 48, ["text"])
    named = F.when(F.col("several"), F.col("sid")).otherwise(F.col("doc_id"))
    return sets, texts.select(named.alias("doc_id"), "text").where(F.col("doc_id").isNotNull())


def links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect what is connected, from the signatures of ``docs``; ends above all doc_ids stand for sets."""
    sets, texts = _named_sets(docs, signed)
    sets = durable(sets)
    same = signed.where("n > 0").select("set_id", F.col("doc_id").alias("b"))
    shared = sets.where("rows > 1 OR sid <> doc_id").select("set_id", F.col("sid").alias("a"), "rows")
    same = keyed_join(same, shared, ["set_id"], "inner", 64, ["b"]).where("a <> b").select("a", "b")
    chosen = signed.join(sets.select("set_id", "doc_id", "mark", "sid"), ["set_id", "doc_id", "mark"]).dropDuplicates(["sid"])
    chosen = durable(chosen.select(F.col("sid").alias("doc_id"), "n", "bands", "signature"))
    banded = chosen.select("doc_id", "n", F.posexplode("bands").alias("band", "key"))
    groups = banded.groupBy("band", "key").agg(F.min(F.struct("doc_id", "n")).alias("h"), F.count("*").alias("rows")).where("rows > 1")
    groups = durable(groups.select("band", "key", F.col("h.doc_id").alias("hub"), F.col("h.n").alias("hub_n"), "rows"))
    members = durable(keyed_join(banded, groups, ["band", "key"], "inner", 64, ["doc_id"]).drop("rows"))
    near = 100 * F.least("n", "hub_n") >= PERCENT * F.greatest("n", "hub_n")
    tested = durable(members.where(near & (F.col("doc_id") != F.col("hub"))).select("hub", "doc_id").distinct())
    found = durable(verify(texts, tested))
    return same.union(found).union(across(texts, members, durable(components(found)), chosen))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of near duplicates of ``docs(doc_id, text)``.

    Result: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is
    component_id).  Texts without words, null or empty, have an empty set and are linked
    with nothing.  Rows that share a doc_id are one document of the component,
    linked with whatever any of their texts is near to.  Rows
    without doc_id are linked with nothing, have no component_id and are kept.  Other
    columns are not read.
    """
    signed = durable(signatures(docs))
    found = durable(components(links(docs, signed)).withColumnsRenamed({"id": "doc_id"}).withColumn("rows", F.lit(1)))
    joined = keyed_join(signed.select("doc_id", F.col("n").alias("n_shingles")), found, ["doc_id"], "left", 32, ["n_shingles"])
    joined = joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs(doc_id, text, ...)`` per component, with all its columns, whatever their names.

    Of rows that share a doc_id one stays; rows without doc_id stay.
    """
    decided = near_duplicates(docs.select("doc_id", "text"))
    gone = durable(decided.where(~F.col("kept")).select("doc_id").distinct())
    twice = durable(decided.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1"))
    kept = keyed_join(docs, gone.withColumn("rows", F.lit(1)).select("doc_id", "rows"), ["doc_id"], "left_anti", 16, ["doc_id"])
    if twice.isEmpty():
        return kept
    named = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.unionByName(kept.where(F.col("doc_id").isNull()))
