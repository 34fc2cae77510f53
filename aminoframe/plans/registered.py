"""The registered queries and their SQL for DuckDB: every descriptor over ``documents``, and the I/O and layout forms."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet
from ..functions.dialect import DuckDb
from ..operators import REGISTRY, Descriptor, ctd, motif
from ..sources.store import file_digests, shared_folder
from ..streaming.ids import report_repeats
from ..streaming.stream import compute_stream_once, readable
from .blocks import compute_long
from .engine import compute, kmer_maps, long_features, long_kmers, make

#: A driver table counts as sequences: its text, cleaned.
_SEQ = "regexp_replace(upper(replace(coalesce({text}, ''), 'ß', 'SS')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the files are split; a table of fewer splits than cores (one small row group) is dealt out by id first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(2 * cores, "doc_id")


def _rounded(df: DataFrame) -> DataFrame:
    """To six decimals for the comparison; the cut is set off a little, as halves are frequent among these values."""
    return df.selectExpr("id", *(f"rint(`{c}` * 1e6D - 0.0013D) / 1e6D + 0D AS `{c}`" for c in df.columns if c != "id"))


def _duckdb_rounded(sql: str) -> str:
    return f"round(({sql})::DOUBLE * 1e6::DOUBLE - 0.0013::DOUBLE) / 1e6::DOUBLE + 0.0::DOUBLE"


def _one(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compute(_documents(spark, sf_dir), make([name])[0], "doc_id", "text"))


def duckdb_sql(one: Descriptor, table: str = "documents", id_sql: str = "doc_id", text: str = "text") -> str:
    d = DuckDb()
    listed = one.features(d)
    sql = f"WITH p0 AS (SELECT {id_sql}::VARCHAR AS id, seq, length(seq)::INT AS n FROM (SELECT *, {_SEQ.format(text=text)} AS seq FROM {table}))"
    stages = d.stages()
    for i, stage in enumerate(stages, 1):
        sql += f",\np{i} AS (SELECT *, " + ", ".join(f"{expr} AS {name}" for name, expr in stage) + f" FROM p{i - 1})"
    return sql + "\nSELECT id, " + ", ".join(f'{_duckdb_rounded(expr)} AS "{one.name}_{name}"' for name, expr in listed) + f" FROM p{len(stages)}"


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences shorter than every window."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type")
    return _rounded(compute(part, make(["sliding_window"])[0], "p_partkey", "p_type"))


def _kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_kmers(_documents(spark, sf_dir), 3, "doc_id", "text")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_features(_one("aac", spark, sf_dir))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compute(_documents(spark, sf_dir), make(["grouped", "aac"]), "doc_id", "text"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compute_stream_once(spark, f"{sf_dir}/documents.parquet", make(["grouped"])[0], "doc_id", "text"))


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the maps of five-residue words, and a digest of all that is in them."""
    spelled = F.transform(F.array_sort(F.map_entries("kmers")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("long").cast("string")))
    return kmer_maps(_documents(spark, sf_dir), 5, "doc_id", "text").select("id", "total_kmers", "unique_kmers", F.coalesce(F.array_max(F.map_values("kmers")), F.lit(0.0)).alias("most"), F.sha2(F.array_join(spelled, ","), 256).alias("kmers_sha256"))


def _stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as ids: those that come more than once in the stream of events, with their last count."""
    events = readable(spark, f"{sf_dir}/events.parquet")
    found = report_repeats(spark, events, shared_folder(spark, "repeats"), "user_id")
    return found.groupBy("id").agg(F.max("n").alias("n"))


#: Figures of windows, runs, ends, words and pairs, of blocks far shorter than most documents.
LONG = {
    "sliding_window": ["win5_hydropathy_mean", "win5_hydropathy_std", "win5_hydropathy_min", "win5_hydropathy_max", "win5_hydropathy_start_end_diff", "win5_hydropathy_high_fraction", "win9_aromatic_frac_max"],
    "run_blockiness": ["longest_homopolymer", "homopolymer_run_density", "repeated_block_fraction_len3", "charged_longest", "charged_n_runs", "charged_fraction_in_runs_len2", "charged_switching_freq"],
    "local_repetition": ["unique_fraction_k3", "top_count_k2", "repeated_span_k3", "recurrence_entropy_k2"],
    "sequence_order": ["aromatic_lag2_coupling", "aromatic_mean_spacing_norm", "polar_nonpolar_transition_frac"],
    "autocorrelation": ["mb_hydrophobicity_lag3", "moran_hydrophobicity_lag3"],
    "terminal": ["cterm20_hydropathy_mean", "nterm20_aac_A"],
}


def _long_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [f"{d}_{f}" for d, features in LONG.items() for f in features]
    return _rounded(compute_long(_documents(spark, sf_dir), make(LONG), "doc_id", "text", named, block=300))


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the files of all tables."""
    return file_digests(spark, f"{sf_dir}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


QUERIES = {name: partial(_one, name) for name in sorted(REGISTRY)} | {"short_sequences": _short, "long_kmers_3": _kmers, "long_layout": _long, "merged": _merged, "stream_grouped": _stream, "content_digests": _digests, "long_sequences": _long_sequences, "kmer_maps_5": _maps, "stream_repeats": _stream_repeats}

def _local_repetition_sql() -> str:
    """Relational: a row for each word, grouped; the array form is slow in DuckDB."""
    nan = "'NaN'::DOUBLE"

    def of(k: int, sql: str) -> str:
        return f"coalesce(max(CASE WHEN k = {k} THEN {sql} END), {nan})"

    out = []
    for name, ks, sql in (
        ("repeated_fraction_k", (2, 3, 4), "rep / m"),
        ("unique_fraction_k", (2, 3, 4), "kinds / m"),
        ("redundancy_score_k", (2, 3, 4), "1 - kinds / m"),
        ("top_count_k", (2, 3), "top"),
        ("top_freq_k", (2, 3), "top / m"),
        ("duplicate_window_fraction_w", (5, 6), "rep / m"),
        ("repeated_word_burden_k", (2, 3), "rep / m"),
        ("recurrence_entropy_k", (2, 3), "CASE WHEN rep > 0 THEN log2(rep) - logs / rep ELSE 0 END"),
        ("repeated_span_k", (2, 3), "span"),
        ("repeated_span_norm_k", (2, 3), "span / n"),
        ("repeated_block_density_k", (2, 3), "rep / m"),
        ("longest_redundant_block_k", (2, 3), "coalesce(longest, 0)"),
        ("recurrence_concentration_k", (2, 3), "CASE WHEN rep > 0 THEN top / rep ELSE 0 END"),
    ):
        out += [(f"{name}{k}", of(k, sql)) for k in ks]
    for w in (8, 10):
        out += [(f"local_redundancy_{stat}_w{w}_k2", of(w, column)) for stat, column in (("mean", "mean"), ("std", "std"))]
    pairs = {w: ", ".join(f"substr(part, {j}, 2)" for j in range(1, w)) for w in (8, 10)}
    windows = " UNION ALL ".join(f"SELECT id, {w} AS k, 1 - len(list_distinct([{pairs[w]}])) / {w - 1} AS r FROM (SELECT id, substr(seq, i, {w}) AS part FROM (SELECT id, seq, unnest(range(1, n - {w - 2})) AS i FROM s WHERE n >= {w}))" for w in (8, 10))
    return f"""
        WITH s AS (SELECT id, seq, length(seq) AS n FROM (SELECT doc_id::VARCHAR AS id, {_SEQ.format(text="text")} AS seq FROM documents)),
        w AS (SELECT id, k, i, substr(seq, i, k) AS word FROM (SELECT id, seq, k, unnest(range(1, n - k + 2)) AS i FROM s, range(2, 7) AS ks(k) WHERE n >= k)),
        c AS (SELECT id, k, word, count(*) AS c, min(i) AS a, max(i) AS b FROM w GROUP BY ALL),
        g AS (SELECT id, k, sum(c)::DOUBLE AS m, count(*)::DOUBLE AS kinds, coalesce(sum(c) FILTER (c > 1), 0)::DOUBLE AS rep, max(c)::DOUBLE AS top,
                     sum(c * log2(c)) FILTER (c > 1) AS logs, avg(b - a) FILTER (c > 1) AS span FROM c GROUP BY id, k),
        runs AS (SELECT id, k, count(*) AS run FROM (SELECT id, k, i - row_number() OVER (PARTITION BY id, k ORDER BY i) AS island FROM w JOIN c USING (id, k, word) WHERE c > 1 AND k < 4) GROUP BY id, k, island),
        block AS (SELECT id, k, max(run)::DOUBLE AS longest FROM runs GROUP BY id, k),
        near AS (SELECT id, k, avg(r) AS mean, stddev_pop(r) AS std FROM ({windows}) GROUP BY id, k),
        rows AS (
            SELECT g.id, g.k, m, kinds, rep, top, logs, span, longest, NULL AS mean, NULL AS std FROM g LEFT JOIN block ON g.id = block.id AND g.k = block.k
            UNION ALL SELECT id, k, NULL, NULL, NULL, NULL, NULL, NULL, NULL, mean, std FROM near
        )
        SELECT s.id, any_value(n)::DOUBLE AS local_repetition_length, any_value(n)::DOUBLE AS local_repetition_valid_residue_count,
            {", ".join(f'{_duckdb_rounded(sql)} AS "local_repetition_{name}"' for name, sql in out)}
        FROM s LEFT JOIN rows ON s.id = rows.id GROUP BY s.id"""


def _spacing_sql() -> str:
    """Relational: a row for each residue and group, and window functions over the rows of a sequence."""
    nan = "'NaN'::DOUBLE"
    of = lambda g, sql: f"coalesce(max(CASE WHEN g = '{g}' THEN {sql} END), {nan})"
    out = []
    for g in ctd.TRACKED:
        out += [(f"{g}_count", f"coalesce(max(CASE WHEN g = '{g}' THEN c END), 0)"), (f"{g}_density", f"CASE WHEN max(n) > 0 THEN coalesce(max(CASE WHEN g = '{g}' THEN c END), 0) / max(n) ELSE {nan} END")]
        out += [(f"{g}_span", of(g, "span")), (f"{g}_span_norm", of(g, "span / n"))]
        out += [(f"{g}_{k}", of(g, f"{k}_gap")) for k in ("mean", "median", "min", "max", "std")]
        out += [(f"{g}_{k}_norm", of(g, f"{k}_gap / n")) for k in ("mean", "median", "max")]
        out += [(f"{g}_nn_{k}", of(g, f"{k}_near")) for k in ("mean", "median", "min", "max")]
    out += [(name, of(name, "mean_gap")) for name in motif.CROSS]
    groups = ", ".join(f"('{g}', '{members}')" for g, members in ctd.TRACKED.items())
    pairs = ", ".join(f"('{name}', '{alphabet.GROUPS[a]}', '{alphabet.GROUPS[b]}')" for name, (a, b) in motif.CROSS.items())
    return f"""
        WITH s AS (SELECT id, seq, length(seq)::DOUBLE AS n FROM (SELECT doc_id::VARCHAR AS id, {_SEQ.format(text="text")} AS seq FROM documents)),
        r AS (SELECT id, i, seq[i] AS residue FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS i FROM s)),
        p AS (
            SELECT id, g, i, i - lag(i) OVER w AS gap, least(i - lag(i) OVER w, lead(i) OVER w - i) AS near
            FROM r JOIN (VALUES {groups}) AS groups(g, members) ON contains(members, residue) WINDOW w AS (PARTITION BY id, g ORDER BY i)
        ),
        x AS (
            SELECT id, name, i, contains(a, residue) AS asks,
                i - last_value(CASE WHEN contains(b, residue) THEN i END IGNORE NULLS) OVER (PARTITION BY id, name ORDER BY i) AS back,
                first_value(CASE WHEN contains(b, residue) THEN i END IGNORE NULLS) OVER (PARTITION BY id, name ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - i AS ahead
            FROM r JOIN (VALUES {pairs}) AS pairs(name, a, b) ON contains(a, residue) OR contains(b, residue)
        ),
        f AS (
            SELECT id, g, count(*)::DOUBLE AS c, CASE WHEN count(*) > 1 THEN max(i) - min(i) END AS span, avg(gap) AS mean_gap, median(gap) AS median_gap, min(gap) AS min_gap, max(gap) AS max_gap, stddev_pop(gap) AS std_gap,
                avg(near) AS mean_near, median(near) AS median_near, min(near) AS min_near, max(near) AS max_near
            FROM p GROUP BY id, g
            UNION ALL BY NAME SELECT id, name AS g, avg(least(back, ahead)) AS mean_gap FROM x WHERE asks GROUP BY id, name
        )
        SELECT id, max(n) AS spacing_length, max(n) AS spacing_valid_residue_count, {", ".join(f'{_duckdb_rounded(sql)} AS "spacing_{name}"' for name, sql in out)}
        FROM s LEFT JOIN f USING (id) GROUP BY id"""


def _long_sequences_sql() -> str:
    """Relational, over rows for residues and words."""
    nan, group = "'NaN'::DOUBLE", alphabet.GROUPS
    out = {
        "sliding_window": ["w.mean", "w.std", "w.low", "w.high", "w.last - w.first", "w.hits", "w.aromatic"],
        "run_blockiness": ["coalesce(h.longest, 0)", "h.runs / n", "coalesce(h.in3 / n, CASE WHEN n > 0 THEN 0 END)", "coalesce(c.longest, 0)", "coalesce(c.runs, 0)", "CASE WHEN n > 0 THEN coalesce(c.in2, 0) / n END", "CASE WHEN n > 1 THEN p.switches / (n - 1) END"],
        "local_repetition": ["k3.kinds / k3.m", "k2.top", "k3.span", "CASE WHEN k2.rep > 0 THEN log2(k2.rep) - k2.logs / k2.rep WHEN k2.m > 0 THEN 0 END"],
        "sequence_order": ["CASE WHEN n > 2 THEN p.coupled / (n - 2) END", "CASE WHEN p.members > 1 THEN p.extent / (p.members - 1) / n END", "CASE WHEN n > 1 THEN p.changes / (n - 1) END"],
        "autocorrelation": ["CASE WHEN n > 3 THEN p.product / (n - 3) END", "CASE WHEN n > 3 AND q.low < q.high THEN q.product / (n - 3) / q.variance END"],
        "terminal": ["t.hydropathy", "t.a"],
    }
    columns = ", ".join(f'{_duckdb_rounded(f"coalesce({sql}, {nan})")} AS "{d}_{name}"' for d, names in LONG.items() for name, sql in zip(names, out[d], strict=True))
    kd = ", ".join(f"('{a}', {v}::DOUBLE)" for a, v in alphabet.HYDROPATHY.items())
    runs = lambda label: f"SELECT id, count(*) AS size FROM (SELECT id, {label} AS label, i - row_number() OVER (PARTITION BY id, {label} ORDER BY i) AS island FROM r) WHERE label IS NOT NULL GROUP BY id, label, island"
    run_figures = "max(size) AS longest, count(*)::DOUBLE AS runs, coalesce(sum(size) FILTER (size > 1), 0)::DOUBLE AS in2, coalesce(sum(size) FILTER (size > 2), 0)::DOUBLE AS in3"
    has = lambda g, x: f"contains('{group[g]}', {x})"
    return f"""
        WITH s AS (SELECT id, seq, length(seq)::DOUBLE AS n FROM (SELECT doc_id::VARCHAR AS id, {_SEQ.format(text="text")} AS seq FROM documents)),
        r AS (
            SELECT id, n, i, residue, v, lead(residue) OVER o AS one, lead(residue, 2) OVER o AS two, lead(v, 3) OVER o AS v3,
                {" + ".join(f"lead(v, {j}) OVER o * 0.2::DOUBLE" for j in range(5))} AS v5, avg({has("aromatic", "residue")}::INT) OVER (o ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS aromatic9
            FROM (SELECT id, n, i, seq[i] AS residue FROM (SELECT id, n, seq, unnest(range(1, length(seq) + 1)) AS i FROM s)) JOIN (VALUES {kd}) AS kd(residue, v) USING (residue)
            WINDOW o AS (PARTITION BY id ORDER BY i)
        ),
        w AS (SELECT id, avg(v5) FILTER (i <= n - 4) AS mean, stddev_pop(v5) FILTER (i <= n - 4) AS std, min(v5) FILTER (i <= n - 4) AS low, max(v5) FILTER (i <= n - 4) AS high,
                     max(v5) FILTER (i = 1 AND n >= 5) AS first, max(v5) FILTER (i = n - 4) AS last, avg((v5 > 1)::INT) FILTER (i <= n - 4) AS hits, max(aromatic9) FILTER (i <= n - 8) AS aromatic FROM r GROUP BY id),
        h AS (SELECT id, {run_figures} FROM ({runs("residue")}) GROUP BY id),
        c AS (SELECT id, {run_figures} FROM ({runs(f"CASE WHEN {has('charged', 'residue')} THEN 1 END")}) GROUP BY id),
        p AS (
            SELECT id, sum(({has("charged", "residue")} <> {has("charged", "one")})::INT) AS switches, sum(({has("aromatic", "residue")} AND {has("aromatic", "two")})::INT) AS coupled,
                count(*) FILTER ({has("aromatic", "residue")}) AS members, (max(i) FILTER ({has("aromatic", "residue")}) - min(i) FILTER ({has("aromatic", "residue")}))::DOUBLE AS extent,
                sum((({has("polar", "residue")} AND {has("nonpolar", "one")}) OR ({has("nonpolar", "residue")} AND {has("polar", "one")}))::INT) AS changes, sum(v * v3) AS product
            FROM r GROUP BY id
        ),
        q AS (SELECT id, sum((v - mean) * (v3 - mean)) AS product, avg((v - mean) * (v - mean)) AS variance, min(v) AS low, max(v) AS high FROM r JOIN (SELECT id, avg(v) AS mean FROM r GROUP BY id) USING (id) GROUP BY id),
        t AS (SELECT id, avg(v) FILTER (i > n - 20) AS hydropathy, avg((residue = 'A')::INT) FILTER (i <= 20) AS a FROM r GROUP BY id),
        words AS (SELECT id, k, word, count(*) AS c, max(i) - min(i) AS span FROM (SELECT id, k, i, substr(seq, i, k) AS word FROM (SELECT id, seq, k, unnest(range(1, length(seq) - k + 2)) AS i FROM s, range(2, 4) AS ks(k) WHERE n >= k)) GROUP BY id, k, word),
        k AS (SELECT id, k, sum(c)::DOUBLE AS m, count(*) AS kinds, max(c) AS top, sum(c) FILTER (c > 1)::DOUBLE AS rep, sum(c * log2(c)) FILTER (c > 1) AS logs, avg(span) FILTER (c > 1) AS span FROM words GROUP BY id, k)
        SELECT s.id, {columns}
        FROM s LEFT JOIN w ON s.id = w.id LEFT JOIN h ON s.id = h.id LEFT JOIN c ON s.id = c.id LEFT JOIN p ON s.id = p.id LEFT JOIN q ON s.id = q.id LEFT JOIN t ON s.id = t.id
            LEFT JOIN k k2 ON s.id = k2.id AND k2.k = 2 LEFT JOIN k k3 ON s.id = k3.id AND k3.k = 3"""


_AAC, _GROUPED = duckdb_sql(make(["aac"])[0]), duckdb_sql(make(["grouped"])[0])
ORACLE_SQL = {name: duckdb_sql(make([name])[0]) for name in sorted(REGISTRY) if name != "spacing"} | {
    "local_repetition": _local_repetition_sql(),
    "spacing": _spacing_sql(),
    "long_sequences": _long_sequences_sql(),
    "short_sequences": duckdb_sql(make(["sliding_window"])[0], "part", "p_partkey", "p_type"),
    "long_kmers_3": f"""
        SELECT id, kmer, count(*)::DOUBLE AS n
        FROM (SELECT id, seq[i:i + 2] AS kmer FROM (SELECT doc_id::VARCHAR AS id, seq, unnest(range(1, length(seq) - 1)) AS i FROM (SELECT *, {_SEQ.format(text="text")} AS seq FROM documents)))
        GROUP BY id, kmer""",
    "kmer_maps_5": f"""
        WITH s AS (SELECT doc_id::VARCHAR AS id, {_SEQ.format(text="text")} AS seq FROM documents),
        w AS (SELECT id, kmer, count(*) AS n FROM (SELECT id, seq[i:i + 4] AS kmer FROM (SELECT id, seq, unnest(range(1, length(seq) - 3)) AS i FROM s)) GROUP BY id, kmer),
        m AS (SELECT id, sum(n) AS total, count(*) AS kinds, max(n) AS most, string_agg(kmer || ':' || n, ',' ORDER BY kmer) AS spelled FROM w GROUP BY id)
        SELECT s.id, coalesce(total, 0)::DOUBLE AS total_kmers, coalesce(kinds, 0)::DOUBLE AS unique_kmers, coalesce(most, 0)::DOUBLE AS most, sha256(coalesce(spelled, '')) AS kmers_sha256
        FROM s LEFT JOIN m ON s.id = m.id""",
    "stream_repeats": "SELECT coalesce(user_id::VARCHAR, '') AS id, count(*)::BIGINT AS n FROM events GROUP BY user_id HAVING count(*) > 1 OR user_id IS NULL",
    "long_layout": f"UNPIVOT ({_AAC}) ON COLUMNS(* EXCLUDE (id)) INTO NAME feature VALUE value",
    "merged": f"SELECT g.* EXCLUDE (grouped_length), grouped_length AS length, a.* EXCLUDE (id, aac_length, aac_valid_residue_count) FROM ({_GROUPED}) g JOIN ({_AAC}) a USING (id)",
    "stream_grouped": _GROUPED,
}
