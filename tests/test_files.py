"""Sources, sinks, configuration, command line, provenance, streams."""

from __future__ import annotations

import json
import re

import pyarrow.csv
import pyarrow.parquet
import pytest

from aminoframe.cli import main
from aminoframe.config import ConfigIssue, check_config, load_config, validate_config
from aminoframe.errors import IdColumnError, IdError, InputError
from aminoframe.operators import REGISTRY, Descriptor, register
from aminoframe.plans.engine import compute, make
from aminoframe.sources.scales import list_indices, load_scales
from aminoframe.sources.tables import read_fasta, read_sequences, write_table
from aminoframe.streaming.stream import compute_stream_once

FASTA = "junk\n\n>p1 some description\nacd\n EFG \n\n>p2\n>\nW\n  >p4 x\nYY\n"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fasta(spark, tmp_path):
    path = tmp_path / "s.fasta"
    path.write_text(FASTA)
    assert rows(read_fasta(spark, str(path))) == [("p1", "ACDEFG"), ("p2", ""), ("", "W"), ("p4", "YY")]
    path.write_text(">a x\r\nacd\r\nef\r\n>b\n>c y z\nW W\n")
    with pytest.raises(InputError):
        read_fasta(spark, str(tmp_path / "none.fasta"))


def test_tables_and_ids(spark, tmp_path):
    csv = tmp_path / "s.csv"
    csv.write_text("id,sequence,label\n001, acd ,1\n2,,0\n")
    assert rows(read_sequences(spark, str(csv))) == [("001", "ACD"), ("2", None)]
    with pytest.raises(IdColumnError):
        read_sequences(spark, str(csv), id_col="name")
    with pytest.raises(InputError):
        read_sequences(spark, str(csv), seq_col="x")
    with pytest.raises(InputError):
        read_sequences(spark, str(tmp_path / "s.txt"))
    csv.write_text("id,sequence\na,A\na,C\nb,D\n")
    with pytest.raises(IdError, match="a"):
        read_sequences(spark, str(csv))
    csv.write_text("id,sequence\n,A\n")
    with pytest.raises(IdError):
        read_sequences(spark, str(csv))


def test_sinks(spark, tmp_path):
    out = compute(spark.createDataFrame([("a", "ACD"), ("b", None)], "id string, sequence string"), make(["aac"])[0])
    for name in ("deep/x.csv", "x.parquet", "x.pq"):
        write_table(out, str(tmp_path / name))
    assert pyarrow.parquet.read_table(tmp_path / "x.parquet").num_rows == 2
    assert pyarrow.csv.read_csv(tmp_path / "deep/x.csv").column_names == out.columns
    write_table(out, str(tmp_path / "parts.parquet"), single_file=False)
    assert spark.read.parquet(str(tmp_path / "parts.parquet")).count() == 2
    with pytest.raises(InputError):
        write_table(out, str(tmp_path / "x.txt"))


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("schema_version: 1\ndescriptors:\n  aac:\n    include_counts: true\n  charge:\n")
    assert load_config(path) == {"aac": {"include_counts": True}, "charge": {}}
    path.write_text("schema_version: 2\nextra: 1\ndescriptors:\n  nope: {}\n  aac: {bogus: 1, include_counts: maybe}\n  aaindex: {codes: [NOT_A_CODE]}\n")
    assert {i.path for i in validate_config(str(path))} == {"schema_version", "extra", "descriptors.nope", "descriptors.aac.bogus", "descriptors.aac.include_counts", "descriptors.aaindex.codes"}
    issues = check_config({"aac": {}})
    assert {i.path for i in issues} == {"aac", "descriptors"} and any("descriptors:" in i.message for i in issues if i.path == "aac")
    assert validate_config({"descriptors": {"aac": {"include_counts": "x"}}}) == [ConfigIssue("descriptors.aac.include_counts", "expected bool, got str")]
    assert validate_config({"descriptors": {"charge": {"ph_values": [7, 7.4]}, "pattern": {"patterns": {"a": "K"}}}}) == []
    assert [i.path for i in validate_config({"descriptors": {"charge": {"ph_values": ["x"], "local_window": True}}})] == ["descriptors.charge.ph_values", "descriptors.charge.local_window"]
    path.write_text("key: [unclosed\n")
    assert [i.path for i in validate_config(path)] == [""] and [i.path for i in validate_config(tmp_path / "none")] == [""]
    assert check_config({"descriptors": {n: {} for n in REGISTRY}, "schema_version": 1}) == []


def test_command_line(spark, tmp_path, capsys):
    path, out = tmp_path / "s.fasta", tmp_path / "o.csv"
    path.write_text(">p1 some description\nACD\n>p2\nWYY\n")
    assert main(["compute", str(path), "-d", "charge", "-d", "aac", "-o", str(out)]) == 0
    assert pyarrow.csv.read_csv(out)["id"].to_pylist() == ["p1", "p2"]
    side = json.loads((tmp_path / "o.csv.provenance.json").read_text())
    assert side["outputs"][0]["n_rows"] == 2 and side["outputs"][0]["n_cols"] == 2 + 42 + 52
    assert list(side["parameters"]["descriptors"]) == ["aac", "charge"] and re.fullmatch("sha256:[0-9a-f]{64}", side["config_fingerprint"])
    assert side["parameters"]["descriptors"]["charge"]["ph_values"] == [5.0, 7.0, 9.0]
    table = tmp_path / "s.csv"
    table.write_text("name,sequence\na,ACD\n")
    assert main(["compute", str(table), "-d", "aac", "-o", str(tmp_path / "n.csv")]) == 2
    assert main(["compute", str(table), "-d", "aac", "-o", str(tmp_path / "n.csv"), "--id-col", "name"]) == 0
    for name, raw in (("bad.csv", b'id,sequence\n"a,ACD\n'), ("bad.fasta", b">a\n\xff\xfe\n"), ("bad.parquet", b"not parquet"), ("dup.fasta", b">a x\nACD\n>a y\nW\n")):
        (tmp_path / name).write_bytes(raw)
        assert main(["compute", str(tmp_path / name), "-d", "aac", "-o", str(tmp_path / "b.csv")]) == 3, name
    for wrong in (["compute", str(path), "-o", "x.csv"], ["compute", str(path), "-d", "nope", "-o", "x.csv"], ["compute", str(path), "-d", "aac", "--config", "c", "-o", "x.csv"], ["describe", "nope"], ["init-config"], ["bogus"]):
        assert main(wrong) == 2
    capsys.readouterr()
    assert main(["list", "-f", "ctd"]) == 0 and "ctd_classic" in capsys.readouterr().out
    assert main(["list", "-f", "none"]) == 0 and "No descriptors" in capsys.readouterr().out
    assert main(["describe", "aac"]) == 0 and "aac_count_A" in capsys.readouterr().out
    config = tmp_path / "c.yaml"
    assert main(["init-config", "--all", "-o", str(config)]) == 0 and validate_config(config) == []
    assert main(["validate-config", str(config)]) == 0
    capsys.readouterr()
    config.write_text("descriptors:\n  nope: {}\n")
    assert main(["validate-config", str(config), "--json"]) == 2
    assert json.loads(capsys.readouterr().out) == [{"path": "descriptors.nope", "message": "unknown descriptor"}]


def test_streams(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(f"{i}", "ACD" * (i + 1))], "id string, sequence string").write.mode("append").parquet(f"{tmp_path}/in")
    made = make(["spacing"])[0]
    got = compute_stream_once(spark, f"{tmp_path}/in", made, "id", "sequence", f"{tmp_path}/s")
    want = compute(spark.read.parquet(f"{tmp_path}/in"), made)
    assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(want)))
    spark.createDataFrame([("9", "W")], "id string, sequence string").write.mode("append").parquet(f"{tmp_path}/in")
    assert compute_stream_once(spark, f"{tmp_path}/in", made, "id", "sequence", f"{tmp_path}/s").count() == 3


def test_own_descriptor_and_scales(spark, tmp_path):
    @register("own", family="mine")
    class Own(Descriptor):
        def features(self, d):
            return [("k", "length(seq) - length(replace(seq, 'K', ''))")]

    try:
        df = spark.createDataFrame([("a", "KAK")], "id string, sequence string")
        assert rows(compute(df, make(["own"])[0])) == [("a", 2.0)]
    finally:
        del REGISTRY["own"]
    path = tmp_path / "scales.csv"
    path.write_text("index,A,C,K\nOWN1,1.5,,2\n")
    assert "OWN1" in load_scales(str(path)) == list_indices()
    row = compute(df, REGISTRY["aaindex"](codes=("OWN1",))).first()
    assert row.aaindex_OWN1_median == 2.0 and abs(row.aaindex_OWN1_mean - 5.5 / 3) < 1e-12


def test_the_rest_works_without_the_text_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['aminoframe.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'aac' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__import__("pathlib").Path(__file__).parents[1])


def test_fasta_is_split_over_tasks(spark, tmp_path):
    """Also with text before the first header, odd line ends and headers, in several files."""
    want = []
    for f in range(3):
        lines = ["; no record", "ACD"][: f] + [""] * f
        for i in range(2000):
            lines += [f"{' ' * (i % 3 == 0)}>{'>' * (i % 7 == 0)}r{f}-{i} some words", "acd" * (i % 50), " WW "]
            want.append((f"{'>' * (i % 7 == 0)}r{f}-{i}", "ACD" * (i % 50) + "WW"))
        (tmp_path / f"{f}.fasta").write_text(["\n", "\r\n", "\n"][f].join(lines), newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = read_fasta(spark, str(tmp_path / "*.fasta"))
        assert found.rdd.getNumPartitions() > 5 and sorted(rows(found)) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_users_may_choose_any_name(spark):
    df = spark.createDataFrame([("a", "KKNASKRW")], "id string, sequence string")
    made = REGISTRY["pattern"](patterns={"N-x-S": "N.S", "x y": "KK", "é'`": "W"}, include_terminal=False)
    row = compute(df, made).first().asDict()
    assert row["pattern_N-x-S_count"] == 1 and row["pattern_x y_present"] == 1 and row["pattern_é'`_density"] == 1 / 8
    both = compute(df, [REGISTRY["pattern"](patterns={"x": "N.S", "X": "K"}), REGISTRY["user_regex"](patterns={"x": "W", "X": "KK"})])
    assert both.first()[[c for c in both.columns].index("pattern_X_count")] == 3
    scale = {a: float(i) for i, a in enumerate("ACDEFGHIKLMNPQRSTVWY")}
    row = compute(df, REGISTRY["autocorrelation"](scales={"my-scale": scale, "my scale": scale}, lags=(1,))).first().asDict()
    assert row["autocorrelation_mb_my-scale_lag1"] == row["autocorrelation_mb_my scale_lag1"] > 0
    groups = {"a-b": "K R", "A-B": "W"}
    row = compute(df, REGISTRY["distribution"](groups=groups)).first().asDict()
    assert row["distribution_a-b_count"] == 4 and row["distribution_A-B_count"] == 1
    row = compute(df, REGISTRY["ctd_classic"](properties=("my prop",), ctd_groups={"my prop": {"1": "K", "2": "N", "3": "W"}})).first().asDict()
    assert row["ctd_classic_my prop_comp_1"] == 3 / 5


def test_one_name_never_stands_for_two_expressions(spark):
    @register("clash", family="mine")
    class Clash(Descriptor):
        def features(self, d):
            return [("x", d.let("v_hydropathy", "length(seq)"))]

    try:
        df = spark.createDataFrame([("a", "KAK")], "id string, sequence string")
        assert rows(compute(df, make(["clash"]))) == [("a", 3.0)]
        with pytest.raises(ValueError, match="v_hydropathy"):
            compute(df, make(["hydrophobicity", "clash"]))
        assert [i.path for i in check_config({"descriptors": {"clash": {"y": 1}}})] == ["descriptors.clash.y"]
    finally:
        del REGISTRY["clash"]


def test_errors_name_their_parameter():
    for name, given in (("kmer_full_alphabet", {"k": 0}), ("user_regex", {"patterns": {"a": "("}}), ("pseaac", {"properties": {"p": {"A": 1.0}}}), ("ctd_classic", {"properties": ["none"]})):
        assert [i.path for i in check_config({"descriptors": {name: given}})] == [f"descriptors.{name}.{next(iter(given))}"]


def test_as_many_scales_as_are_published(spark, tmp_path):
    """566 of them, some without values for some residues, in one stage."""
    import random

    import numpy as np

    from aminoframe.sources import scales

    r, letters = random.Random(5), "ARNDCQEGHILKMFPSTWYV"
    made = {f"TEST{i:06d}": {a: round(r.uniform(-9, 9), 2) for a in letters if i % 7 or r.random() < 0.8} for i in range(566)}
    made["TEST000000"] = {}
    path = tmp_path / "scales.csv"
    path.write_text("index," + ",".join(letters) + "\n" + "".join(f"{code}," + ",".join(str(s.get(a, "")) for a in letters) + "\n" for code, s in made.items()))
    seqs = ["", "A", "ACD" * 7, "".join(r.choices(letters, k=300))]
    try:
        assert len([c for c in load_scales(str(path)) if c.startswith("TEST")]) == 566
        df = spark.createDataFrame([(str(i), s) for i, s in enumerate(seqs)], "id string, sequence string").coalesce(2)
        out = compute(df, REGISTRY["aaindex"](codes=tuple(made)))
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and len(out.columns) == 3 + 566 * 7
        for row in out.collect():
            s = seqs[int(row.id)]
            for code in list(made)[::15]:
                v = [np.array([made[code][a] for a in part if a in made[code]]) for part in (s, s[:10], s[-10:])]
                want = [f(v[0]) if len(v[0]) else np.nan for f in (np.mean, np.std, np.min, np.max, np.median)] + [np.mean(x) if len(x) else np.nan for x in v[1:]]
                got = [row[f"aaindex_{code}_{k}"] for k in ("mean", "std", "min", "max", "median", "nterm_mean_w10", "cterm_mean_w10")]
                assert np.allclose(got, want, rtol=1e-9, atol=1e-9, equal_nan=True), (code, got, want)
    finally:
        for code in made:
            scales._ADDED.pop(code, None)


@pytest.mark.parametrize("whole_bytes", [1 << 20, 3])
def test_a_folders_digest_is_that_of_its_files(spark, tmp_path, whole_bytes):
    """Files of over ``whole_bytes`` are read in pieces; the result is the same."""
    import hashlib

    from aminoframe.sources.store import content_digest, file_digests

    (tmp_path / "x/b/c d").mkdir(parents=True)
    names = ("b.txt", "b/a.txt", "a.txt", "b/c d/e=1.txt", "b-a.txt")
    for name in names:
        (tmp_path / "x" / name).write_text(name)
    (tmp_path / "x/_SUCCESS").touch()
    (tmp_path / "x/b/.hidden").write_text("sum")
    (tmp_path / "x/b/.a.txt.crc").write_text("not content")
    (tmp_path / "x/empty.txt").touch()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = "".join(f"{p.relative_to(tmp_path / 'x').as_posix()}\t{sha(p.read_bytes())}\n" for p in sorted((tmp_path / "x").rglob("*")) if p.is_file() and p.suffix != ".crc")
    assert content_digest(spark, str(tmp_path / "x"), whole_bytes) == sha(want.encode()) == content_digest(spark, (tmp_path / "x").as_uri() + "/", whole_bytes)
    assert content_digest(spark, str(tmp_path / "x/b.txt"), whole_bytes) == sha(b"b.txt")
    assert content_digest(spark, str(tmp_path / "x/*.txt"), whole_bytes) == sha("".join(f"{n}\t{sha(n.encode() if n != 'empty.txt' else b'')}\n" for n in ("a.txt", "b-a.txt", "b.txt", "empty.txt")).encode())
    found = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in file_digests(spark, str(tmp_path / "x"), whole_bytes).collect()}
    assert found["empty.txt"] == (0, sha(b"")) and len(found) == 7
    with pytest.raises(InputError):
        content_digest(spark, str(tmp_path / "none"))


def test_digests_of_the_tables(spark):
    import hashlib
    from pathlib import Path

    from aminoframe.plans.registered import QUERIES

    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path("/root/testdata/sf0.001").glob("*.parquet")}
    assert {r.file: (r.length, r.sha256) for r in QUERIES["content_digests"](spark, "/root/testdata/sf0.001").collect()} == want


def test_names_of_stores():
    import pyarrow.fs

    from aminoframe.sources import store

    assert store.arrow_store("file:/a/b") == (pyarrow.fs.LocalFileSystem(), "/a/b") == store.arrow_store("file:///a/b") == store.arrow_store("/a/b")
    asked = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(store.pyarrow.fs, "FileSystem", type("Any", (), {"from_uri": staticmethod(lambda uri: asked.append(uri) or (None, uri))}))
        for scheme in ("s3a", "s3n", "s3", "gs"):
            store.arrow_store(f"{scheme}://bucket/key")
    assert asked == ["s3://bucket/key"] * 3 + ["gs://bucket/key"]


def test_ids_of_a_stream(spark, tmp_path):
    """Repeats within a batch, over batches of one run, and after a restart; missing ids."""
    from aminoframe.streaming.ids import repeats, report_repeats, require_unique

    (tmp_path / "in").mkdir()

    def add(name, *ids):
        (tmp_path / "in" / f"{name}.csv").write_text("id,sequence\n" + "".join(f"{i},ACD\n" for i in ids))

    stream = lambda: spark.readStream.schema("id string, sequence string").option("header", True).option("maxFilesPerTrigger", 1).csv(f"file://{tmp_path}/in")
    folder = f"file://{tmp_path}/state"
    assert report_repeats(spark, stream(), folder).collect() == []
    add("a", "x", "y")
    require_unique(spark, stream(), folder)
    add("b", "z", "w", "w")
    add("c", "z")
    found = {(r.id, r.n) for r in report_repeats(spark, stream(), folder).collect()}
    assert found == {("w", 2), ("z", 2)}
    add("d", "x", "x", "v")
    found = report_repeats(spark, stream(), folder)
    assert {(r.id, r.n) for r in found.collect()} == {("w", 2), ("z", 2), ("x", 3)} and found.columns == ["batch", "id", "n"]
    assert report_repeats(spark, stream(), folder).count() == 3
    with pytest.raises(IdError, match="w, x, z"):
        require_unique(spark, stream(), folder)
    add("e", "", "u")
    with pytest.raises(IdError, match="no id"):
        require_unique(spark, stream(), folder)
    assert repeats(stream()).isStreaming


def test_grouped_forms_of_a_stream(spark, tmp_path):
    from aminoframe.plans.engine import kmer_maps, long_kmers

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "ACAC"), ("b", "KK")], "id string, sequence string").write.parquet(f"{tmp_path}/in/one")
    stream = lambda: spark.readStream.schema("id string, sequence string").parquet(f"{tmp_path}/in/*")
    for name, table, mode in (("words", long_kmers(stream(), 2), "complete"), ("maps", kmer_maps(stream(), 2), "append")):
        run = table.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        run.awaitTermination()
    assert {tuple(r) for r in spark.table("words").collect()} == {("a", "AC", 2.0), ("a", "CA", 1.0), ("b", "KK", 1.0)}
    assert {r.id: r.kmers for r in spark.table("maps").collect()} == {"a": {"AC": 2.0, "CA": 1.0}, "b": {"KK": 1.0}}
