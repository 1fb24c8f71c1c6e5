"""Deterministic selection: top-N, quotas, samples, first-wins unions and exclusions."""

from __future__ import annotations

import hashlib
import os
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import local_path, shared_folder, stored


def top_per_key(df: DataFrame, key: str, order: list, per_key: int, n: int) -> DataFrame:
    """At most ``per_key`` rows of each key, then the first n; ``number`` is the place."""
    few = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= per_key).drop("_r")
    first = few.orderBy(*order).limit(n)
    return first.withColumn("number", F.row_number().over(Window.orderBy(*order)))  # n rows


def sample_per_stratum(df: DataFrame, stratum: str, key: str, seed: str, quotas: dict[str, int]) -> DataFrame:
    """The quota's number of rows of each stratum, by hash of seed and key: the same rows however they are stored."""
    want = F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(stratum))
    h = F.sha2(F.concat(F.lit(seed), F.col(key)).cast("binary"), 256)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(h, key))).where(F.col("place") <= want)


def first_per_bucket(df: DataFrame, buckets: list[tuple[str, Column, int]], order: str) -> DataFrame:
    """Each row in the first bucket (name, condition, quota) whose condition holds; of each bucket the first rows up to its quota."""
    name, quota = (reduce(lambda acc, x: acc.when(x[1], x[k]), buckets[1:], F.when(buckets[0][1], buckets[0][k])) for k in (0, 2))
    d = df.withColumn("bucket", name).withColumn("_q", quota).where("bucket is not null")
    return d.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(order))).where("place <= _q").drop("_q")


def samples_in_turn(df: DataFrame, buckets: list[tuple[str, Column, int]], order: list) -> DataFrame:
    """df's rows with ``bucket`` and ``place``: of each bucket (name, condition, quota) in turn the first rows by order that no earlier bucket took.

    A row that fits a full bucket goes on to the next that it fits. Only the first rows of each combination of buckets can
    be taken, as many as all quotas together; these few are dealt bucket by bucket.
    """
    most = sum(q for _, _, q in buckets)
    fits = F.array(*[F.coalesce(c, F.lit(False)) for _, c, _ in buckets])
    w = Window.partitionBy("_fits").orderBy(*order)
    few = df.withColumn("_fits", fits).where(F.exists("_fits", lambda x: x)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    rank = F.row_number().over(Window.orderBy(*order)).alias("_rank")
    few = few.select("*", rank)  # at most the quotas together for each combination
    taken = None
    for k, (name, _, quota) in enumerate(buckets):
        left = few.where(F.col("_fits")[k])
        left = left if taken is None else left.join(taken.select("_rank"), "_rank", "left_anti")
        got = left.withColumn("place", F.row_number().over(Window.orderBy("_rank"))).where(F.col("place") <= quota).select("_rank", F.lit(name).alias("bucket"), "place")
        taken = got if taken is None else taken.unionByName(got)
    return few.join(taken, "_rank").drop("_fits", "_n", "_rank")


def first_source(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of all frames, each key from the first frame that has it."""
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("priority", F.lit(k)) for k, f in enumerate(frames)])
    w = Window.partitionBy(key).orderBy("priority")
    return all_.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def stratified_split(df: DataFrame, pool: str, key: str, order: list, quotas: dict[str, int]) -> DataFrame:
    """Each company once, by order; alternately dev and test within its pool up to the quotas, the rest rejected with a reason."""
    d = df.withColumn("_c", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    d = d.withColumn("_p", F.row_number().over(Window.partitionBy(pool, F.col("_c") == 1).orderBy(*order)))
    half = lambda name: F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.lit(name))
    place, split = F.ceil(F.col("_p") / 2), F.when(F.col("_p") % 2 == 1, "dev").otherwise("test")
    quota = F.when(F.col("_p") % 2 == 1, half("dev")).otherwise(half("test"))
    kept = (F.col("_c") == 1) & (place <= quota)
    reason = F.when(F.col("_c") > 1, "company_used").when(~kept, "quota_full")
    return d.select(*df.columns, F.when(kept, split).otherwise("rejected").alias("split"), reason.alias("reason"))


# Slices and categories of the pools, and quotas.
PRIMARY = ("S1_FIN_COMP", "S3_CO_COMP", "S1_FIN_TYPED", "S3_CO_TYPED")
CONTROL = "S6_BASELINE_SINGLE"
CONTROL_KINDS = ("Financials", "Company Overview", "Footnotes", "Risk", "Legal", "Governance")
DEMO_KINDS = (*CONTROL_KINDS, "Accounting", "Shareholder Return")
POOL_QUOTAS = {"dev": 20, "test": 20, "control": 5, "demo": 5, "overview": 6, "per_ticker": 2}


def deal_in_turn(overview: list, financials: list, quotas: dict[str, int]) -> dict:
    """{key: split} for (key, company) in order: so many overviews to dev and then to test, and all others to whichever is shorter, a company once in test."""
    dev, test, used, companies = [], [], {}, set()
    n = {"dev": 0, "test": 0}

    def add(row, target) -> bool:
        key, company = row
        if key in used or (target is test and company != "Unknown" and company in companies) or len(target) >= quotas["dev" if target is dev else "test"]:
            return False
        target.append(key)
        used[key] = "dev" if target is dev else "test"
        if target is test:
            companies.add(company)
        return True

    for row in overview:
        for name, target in (("dev", dev), ("test", test)):
            if n[name] < quotas["overview"]:
                n[name] += add(row, target)
                break
        else:
            break
    for row in [*financials, *overview]:
        if row[0] not in used:
            first, second = (dev, test) if len(dev) <= len(test) else (test, dev)
            _ = add(row, first) or add(row, second)
        if len(dev) >= quotas["dev"] and len(test) >= quotas["test"]:
            break
    return used


def pools(candidates: DataFrame, priority: tuple[str, ...], least: float = 8.0, quotas: dict[str, int] = POOL_QUOTAS) -> DataFrame:
    """candidates with split and reason: dev, test, control, demo, or none with the one reason of the rejection.

    candidates: (source_id, company, ticker, category, slice, facts, quality, fairness). Dev and test are dealt in turn
    from those of the primary slices with two facts and enough quality, best first; controls come from what is left, by
    fairness; demos, two of a priority ticker at most, from what is left then. Only rows that can be reached by the
    quotas are dealt one by one: of a company, no more than dev can take and one, and of those the first few hundred.
    """
    spark = candidates.sparkSession
    best = [F.desc("quality"), F.desc("fairness"), "source_id"]
    ok = (F.col("facts") >= 2) & (F.col("quality") >= least)
    primary = candidates.where(ok & F.col("slice").isin(*PRIMARY))
    reach = (quotas["dev"] + 1) * (quotas["test"] + 1) + quotas["dev"] + quotas["test"]  # rows that the quotas can reach at most

    def first(category: str) -> list:
        known = F.when(F.col("company") == "Unknown", F.concat(F.lit("?"), F.col("source_id").cast("string"))).otherwise(F.col("company"))
        few = primary.where(F.col("category") == category).withColumn("_k", known)
        few = few.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(*best))).where(F.col("_r") <= quotas["dev"] + 1)
        return [(r.source_id, r.company) for r in few.orderBy(*best).limit(reach).select("source_id", "company").collect()]  # bounded by reach

    dealt = deal_in_turn(first("Company Overview"), first("Financials"), quotas)
    split = spark.createDataFrame([(k, v) for k, v in dealt.items()], f"source_id {candidates.schema['source_id'].dataType.simpleString()}, split string")
    c = candidates.join(F.broadcast(split), "source_id", "left")  # dev and test rows at most

    def take(df: DataFrame, name: str, pool: Column, order: list, n: int, per: str | None = None, most: int = 0) -> DataFrame:
        left = df.where(pool & F.col("split").isNull())
        if per:
            left = left.withColumn("_r", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("_r") <= most)
        ids = left.orderBy(*order).limit(n).select("source_id", F.lit(name).alias("_s"))
        return df.join(F.broadcast(ids), "source_id", "left").withColumn("split", F.coalesce("split", "_s")).drop("_s")  # n rows

    controls = (F.col("slice") == CONTROL) & (F.col("facts") >= 1) & (F.col("quality") >= least) & F.col("category").isin(*CONTROL_KINDS)
    c = take(c, "control", controls, [F.desc("fairness"), F.desc("facts"), F.desc("quality"), "source_id"], quotas["control"])
    demos = F.col("ticker").isin(*priority) & ok & F.col("category").isin(*DEMO_KINDS)
    c = take(c, "demo", demos, [F.desc("facts"), F.desc("quality"), "source_id"], quotas["demo"], "ticker", quotas["per_ticker"])
    reason = F.when(F.col("facts") == 0, "no_parser_verified_required_facts").when(F.col("quality") < least, "quality_score_below_selection_threshold").otherwise("lower_score_or_duplicate")
    return c.select(*candidates.columns, F.coalesce("split", F.lit("rejected")).alias("split"), F.when(F.col("split").isNull(), reason).alias("reason"))


#: Links of a case and a document that are worked on at once in a task.
LINKS = 200_000


def stored_texts(docs: DataFrame) -> tuple[str, list[tuple[str, int, int]]]:
    """docs (doc_id, t) in a folder that all executors share, and its files (name, smallest and largest doc_id).

    Each text is there once, in order of doc_id, then text: name.bin has the texts one after the other, name.npy the
    doc_id, place in name.bin, bytes and characters of each (-1 for a null text). Files of a task that is run again have
    another name. The folder needs to be mounted as a file system.
    """
    folder = local_path(shared_folder(docs.sparkSession))

    def write(batches):
        name, rows, at = uuid.uuid4().hex, [], 0
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{name}.bin", "wb") as f:
            for b in batches:
                ids, t = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("t")
                n = pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype("int64")
                for x in t:
                    if x.is_valid:
                        f.write(x.as_buffer())
                chars = pc.fill_null(pc.utf8_length(t), -1).to_numpy(zero_copy_only=False).astype("int64")
                rows.append(np.stack([ids, at + np.cumsum(n) - n, n, chars]))
                at += int(n.sum())
        if rows and rows[0].size:
            rows = np.concatenate(rows, axis=1)
            np.save(f"{folder}/{name}.npy", rows)
            yield pa.RecordBatch.from_pydict({"name": [name], "first": [int(rows[0, 0])], "last": [int(rows[0, -1])]})

    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "t").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "t")
    files = d.mapInArrow(write, "name string, first long, last long").collect()  # a row a file
    return folder, sorted(map(tuple, files), key=lambda x: x[1])


def contexts(links: DataFrame, docs: DataFrame) -> DataFrame:
    """(case_id, sources, chars, context) of each case: its documents, the characters of their texts, and the hash of the texts in order of doc_id.

    links: (case_id, doc_id); docs: (doc_id, t). Texts are not sent to cases but read where they are stored, so disk grows
    with links and texts, not with both at once. A task goes through the texts in order for about LINKS links at a time and
    reads each that these have once, with a hash begun for each list of documents. Cases with the same documents are worked
    out once. Null texts have no characters; a case with only such texts has neither characters nor hash.
    """
    folder, files = stored_texts(docs)
    lists = stored(links.groupBy("case_id").agg(F.sort_array(F.collect_set(F.col("doc_id").cast("long"))).alias("ids")))
    most = LINKS

    def work(lists_):
        """(sources, chars, context) of each list of documents."""
        sizes = [len(x) for x in lists_]
        ids, case = np.concatenate([*lists_, np.empty(0, "int64")]).astype("int64"), np.repeat(np.arange(len(lists_)), sizes)
        order = np.argsort(ids, kind="stable")
        ids, case = ids[order], case[order]
        sources, chars, hashes = [0] * len(sizes), [0] * len(sizes), [None] * len(sizes)
        for name, first, last in files:
            lo, hi = np.searchsorted(ids, first), np.searchsorted(ids, last, "right")
            if lo == hi:
                continue
            has, place, size, length = np.load(f"{folder}/{name}.npy", mmap_mode="r")
            docs_, begin = np.unique(ids[lo:hi], return_index=True)
            ends = [*begin[1:], hi - lo]
            with open(f"{folder}/{name}.bin", "rb") as f:
                for of, to, b, e in zip(np.searchsorted(has, docs_), np.searchsorted(has, docs_, "right"), begin, ends):
                    for k in range(of, to):
                        n = int(length[k])
                        if n >= 0:
                            f.seek(int(place[k]))
                            text = f.read(int(size[k]))
                            next_ = b"\n" + text
                        for c in case[lo + b : lo + e].tolist():
                            sources[c] += 1
                            if n >= 0:
                                chars[c] += n
                                if hashes[c] is None:
                                    hashes[c] = hashlib.sha256(text)
                                else:
                                    hashes[c].update(next_)
        return [(s, c if h else None, h.hexdigest()[:16] if h else None) for s, c, h in zip(sources, chars, hashes)]

    def read(batches):
        for b in batches:
            column = b.column("ids")
            begin = 0
            ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
            while begin < len(column):
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
                part = column.slice(begin, end - begin)
                made = work([x.values.to_numpy(zero_copy_only=False) for x in part])
                cols = list(zip(*made))
                yield pa.RecordBatch.from_arrays([part, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["ids", "sources", "chars", "context"])
                begin = end

    made = lists.select("ids").distinct().mapInArrow(read, "ids array<long>, sources long, chars long, context string")
    return lists.join(made.where("sources > 0"), "ids").select("case_id", "sources", "chars", "context")
