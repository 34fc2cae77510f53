"""Descriptors on small and random sequences, against plain numpy, and the properties that all of them share."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from aminoframe.functions import alphabet as A
from aminoframe.operators import REGISTRY
from aminoframe.plans.engine import compute, long_kmers, make

R = random.Random(4)
ALL = A.RESIDUES
SEQS = ["", None, " *acdef* ", "A", "AC", "ACK", "ACDE", "K" * 6, "A" * 10, "KKKKACDE", "RKEDQN", "KKKACDE", "FLPVLAGLTPSIVPKLVCLLTKKC", ALL, "ILVMFYWHKCAT", "SAPREKGSAPREKG", "VIVIVIVIVI", "BJOUXZ", "straße"]
SEQS += ["".join(R.choices(ALL, k=n)) for n in (*range(1, 31), 300, 1000)]
CLEAN = ["".join(c for c in (s or "").upper() if c in ALL) for s in SEQS]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(str(i), s) for i, s in enumerate(SEQS)], "id string, sequence string").repartition(3)


_DONE: dict[str, list] = {}


@pytest.fixture
def of(table):
    """Rows of a descriptor in the order of SEQS, computed once."""

    def rows(name):
        if name not in _DONE:
            _DONE[name] = sorted(compute(table, make([name])[0]).collect(), key=lambda r: int(r.id))
        return _DONE[name]

    return rows


def same(got, want):
    return math.isnan(got) if math.isnan(want) else abs(got - want) <= 1e-9 * max(1, abs(want))


def check(rows, column, plain):
    for row, s in zip(rows, CLEAN, strict=True):
        assert same(row[column], plain(s)), (column, s, row[column], plain(s))


NAN = float("nan")
EXPECTED = {"aac": 44, "dpc": 805, "kmer_full_alphabet": 804, "grouped": 35, "compositional_bias": 23, "entropy_complexity": 20, "local_repetition": 35, "run_blockiness": 60, "ctd_classic": 65, "distribution": 226, "family_summary": 25, "pseaac": 28, "qso": 28, "sequence_order": 42, "autocorrelation": 77, "aaindex": 30, "pattern": 47, "user_regex": 90, "spacing": 134, "functional_residue_content": 78, "charge": 54, "global_basic": 44, "hydrophobicity": 137, "order_disorder": 30, "structural_propensity": 55, "normalized": 102, "sliding_window": 104, "terminal": 254}


def test_all_descriptors_are_there():
    assert {n: len(c().columns()) for n, c in REGISTRY.items()} == EXPECTED
    assert sum(EXPECTED.values()) == 3476 and len({c.family for c in REGISTRY.values()}) == 10


@pytest.mark.parametrize("name", sorted(set(EXPECTED) - {"dpc", "kmer_full_alphabet"}))
def test_types_prefix_and_order(table, name):
    made = make([name])[0]
    out = compute(table, made)
    assert out.columns == ["id", *(f"{name}_{c}" for c in made.columns())]
    assert {t for c, t in out.dtypes if c != "id"} == {"double"}


@pytest.mark.parametrize("name", sorted(set(EXPECTED) - {"dpc", "kmer_full_alphabet"}))
def test_no_null_and_empty_sequences(of, name):
    for row, s in zip(of(name), CLEAN, strict=True):
        assert all(v is not None for v in row)
        if not s:
            assert row[f"{name}_length"] == 0
            assert all(math.isnan(v) or v == 0 for v in row[1:])


def windows(s, w):
    return [s[i : i + w] for i in range(len(s) - w + 1)]


def entropy(s):
    p = np.array(list(Counter(s).values())) / len(s) if s else np.array([])
    return float(-(p * np.log2(p)).sum()) if s else NAN


def rolled(s, scale, w):
    v = np.array([scale[a] for a in s])
    return np.convolve(v, np.ones(w) / w, "valid") if len(s) >= w else np.array([])


STATS = {"mean": np.mean, "std": np.std, "min": np.min, "max": np.max, "amplitude": np.ptp, "start_end_diff": lambda v: v[-1] - v[0]}


def test_composition(of):
    for a in "AKW":
        check(of("aac"), f"aac_count_{a}", lambda s: s.count(a))
        check(of("aac"), f"aac_freq_{a}", lambda s: s.count(a) / len(s) if s else NAN)
    check(of("aac"), "aac_unique_residue_count", lambda s: len(set(s)))
    freqs = lambda s: np.array(sorted(s.count(a) / len(s) for a in ALL))
    check(of("compositional_bias"), "compositional_bias_top3_burden", lambda s: freqs(s)[-3:].sum() if s else NAN)
    check(of("compositional_bias"), "compositional_bias_usage_std", lambda s: freqs(s).std() if s else NAN)
    check(of("compositional_bias"), "compositional_bias_kl_div_uniform", lambda s: sum(p * math.log2(20 * p) for p in freqs(s) if p) if s else NAN)
    check(of("compositional_bias"), "compositional_bias_gini_like_inequality", lambda s: 2 * (freqs(s) * np.arange(1, 21)).sum() / 20 - 21 / 20 if s else NAN)


def test_pairs_and_words(table):
    rows = sorted(compute(table, make(["dpc"])[0]).collect(), key=lambda r: int(r.id))
    for pair in ("AA", "KK", "AC", "VI", "YY"):
        check(rows, f"dpc_count_{pair}", lambda s: sum(w == pair for w in windows(s, 2)))
    check(rows, "dpc_unique_dipeptides", lambda s: len(set(windows(s, 2))))
    for row, s in zip(rows, CLEAN, strict=True):
        assert sum(row[f"dpc_count_{a}{b}"] for a in ALL for b in ALL) == max(0, len(s) - 1)
    want = Counter((str(i), w) for i, s in enumerate(CLEAN) for w in windows(s, 4))
    assert {(r.id, r.kmer): r.n for r in long_kmers(table, 4).collect()} == want


@pytest.mark.parametrize("k", [2, 3])
def test_repetition(of, k):
    name, rows = "local_repetition", of("local_repetition")
    counts = lambda s: Counter(windows(s, k))
    again = lambda s: [c for c in counts(s).values() if c > 1]
    some = lambda f: lambda s: f(s) if len(s) >= k else NAN
    check(rows, f"{name}_repeated_fraction_k{k}", some(lambda s: sum(again(s)) / len(windows(s, k))))
    check(rows, f"{name}_top_count_k{k}", some(lambda s: max(counts(s).values())))
    check(rows, f"{name}_recurrence_entropy_k{k}", some(lambda s: -sum(c / sum(again(s)) * math.log2(c / sum(again(s))) for c in again(s)) + 0.0))
    check(rows, f"{name}_recurrence_concentration_k{k}", some(lambda s: max(again(s)) / sum(again(s)) if again(s) else 0))

    def span(s):
        places = [(s.find(w), s.rfind(w)) for w, c in counts(s).items() if c > 1]
        return float(np.mean([b - a for a, b in places])) if places else NAN

    check(rows, f"{name}_repeated_span_k{k}", span)

    def block(s):
        marks = "".join("x" if counts(s)[w] > 1 else " " for w in windows(s, k))
        return max(map(len, marks.split()), default=0)

    check(rows, f"{name}_longest_redundant_block_k{k}", some(block))
    inner = lambda s: [1 - len(set(windows(x, 2))) / 7 for x in windows(s, 8)]
    check(rows, f"{name}_local_redundancy_std_w8_k2", lambda s: float(np.std(inner(s))) if len(s) >= 8 else NAN)


def test_runs(of):
    rows = of("run_blockiness")
    for g in ("charged", "polar"):
        mark = lambda s: "".join("x" if a in A.GROUPS[g] else " " for a in s)
        runs = lambda s: [len(x) for x in mark(s).split()]
        check(rows, f"run_blockiness_{g}_n_runs", lambda s: len(runs(s)))
        check(rows, f"run_blockiness_{g}_longest", lambda s: max(runs(s), default=0))
        check(rows, f"run_blockiness_{g}_blockiness", lambda s: np.mean(runs(s)) / sum(runs(s)) if runs(s) else NAN)
        check(rows, f"run_blockiness_{g}_switching_freq", lambda s: sum(a != b for a, b in zip(mark(s), mark(s)[1:], strict=False)) / (len(s) - 1) if len(s) > 1 else NAN)
    check(rows, "run_blockiness_homopolymer_run_density", lambda s: (1 + sum(a != b for a, b in zip(s, s[1:], strict=False))) / len(s) if s else NAN)


@pytest.mark.parametrize("w", [5, 9])
def test_windows(of, w):
    for name, scale in (("hydropathy", A.HYDROPATHY), ("polarity", A.POLARITY)):
        for k, f in STATS.items():
            check(of("sliding_window"), f"sliding_window_win{w}_{name}_{k}", lambda s: f(rolled(s, scale, w)) if len(s) >= w else NAN)
    check(of("sliding_window"), f"sliding_window_win{w}_entropy_mean", lambda s: np.mean([entropy(x) for x in windows(s, w)]) if len(s) >= w else NAN)
    check(of("sliding_window"), f"sliding_window_win{w}_low_entropy_fraction", lambda s: np.mean([entropy(x) < 1.5 for x in windows(s, w)]) if len(s) >= w else NAN)
    hydrophobic = dict.fromkeys(ALL, 0.0) | dict.fromkeys(A.GROUPS["hydrophobic"], 1.0)
    check(of("hydrophobicity"), f"hydrophobicity_w{w}_hydrophobic_patch_fraction", lambda s: np.mean(rolled(s, hydrophobic, w) > 0.6) if len(s) >= w else NAN)
    if w == 5:
        check(of("structural_propensity"), "structural_propensity_w5_helix_high_fraction", lambda s: np.mean(rolled(s, A.HELIX, 5) > 1.0) if len(s) >= 5 else NAN)


def test_positions(of):
    for g in ("charged", "gly"):
        members = {"gly": "G"}.get(g, A.GROUPS.get(g))
        at = lambda s: np.array([i + 1 for i, a in enumerate(s) if a in members])
        check(of("normalized"), f"normalized_{g}_median_norm", lambda s: np.median(at(s) / len(s)) if len(at(s)) else NAN)
        check(of("normalized"), f"normalized_{g}_n_bias", lambda s: np.mean(at(s) / len(s) <= 0.33) if len(at(s)) else NAN)
        check(of("spacing"), f"spacing_{g}_median", lambda s: np.median(np.diff(at(s))) if len(at(s)) > 1 else NAN)
        check(of("spacing"), f"spacing_{g}_std", lambda s: np.std(np.diff(at(s))) if len(at(s)) > 1 else NAN)

        def near(s):
            p = at(s)
            return [min(abs(a - b) for b in p if a != b) for a in p] if len(p) > 1 else []

        check(of("spacing"), f"spacing_{g}_nn_mean", lambda s: np.mean(near(s)) if near(s) else NAN)
        check(of("spacing"), f"spacing_{g}_nn_median", lambda s: np.median(near(s)) if near(s) else NAN)
        check(of("distribution"), f"distribution_{g}_quartile_bin4_frac", lambda s: (np.histogram(at(s) / len(s), 4, (0, 1))[0][3] / len(at(s)) if len(at(s)) else 0.0) if s else NAN)

    def cross(s):
        a, b = ([i for i, x in enumerate(s) if x in A.GROUPS[g]] for g in ("aromatic", "polar"))
        return float(np.mean([min(abs(x - y) for y in b) for x in a])) if a and b else NAN

    check(of("spacing"), "spacing_aromatic_polar_cross_mean", cross)


def test_order(of):
    v = lambda s, scale: np.array([scale[a] for a in s])

    def moran(s):
        x = v(s, A.VOLUME)
        return np.mean((x[:-2] - x.mean()) * (x[2:] - x.mean())) / x.var() if len(s) > 2 and np.ptp(x) > 0 else NAN

    def geary(s):
        x = v(s, A.VOLUME)
        return np.mean((x[:-2] - x[2:]) ** 2) / 2 / x.var(ddof=1) if len(s) > 2 and np.ptp(x) > 0 else NAN

    check(of("autocorrelation"), "autocorrelation_moran_volume_lag2", moran)
    check(of("autocorrelation"), "autocorrelation_geary_volume_lag2", geary)

    def theta(s):
        z = [np.array([p[a] for a in ALL]) for p in (A.EISENBERG, A.HYDROPHILICITY, A.SIDECHAIN_MASS)]
        z = np.array([(x - x.mean()) / x.std() for x in z])
        x = z[:, [ALL.index(a) for a in s]] if s else z[:, :0]
        t = [np.mean((x[:, :-k] - x[:, k:]) ** 2) if len(s) > k else 0.0 for k in range(1, 6)]
        return 0.05 * t[0] / (1 + 0.05 * sum(t)) if s else NAN

    check(of("pseaac"), "pseaac_theta_1", theta)
    for name in ("pseaac", "qso"):
        check(of(name), f"{name}_feature_sum", lambda s: 1.0 if s else NAN)
    g = A.GROUPS["polar"]
    check(of("sequence_order"), "sequence_order_polar_cluster_frac_w3", lambda s: np.mean([sum(a in g for a in w) >= 2 for w in windows(s, 3)]) if len(s) > 2 else NAN)
    check(of("sequence_order"), "sequence_order_polar_lag2_coupling", lambda s: np.mean([s[i] in g and s[i + 2] in g for i in range(len(s) - 2)]) if len(s) > 2 else NAN)


def test_charge_and_basics(of):
    def net(s, ph=7.0):
        if not s:
            return NAN
        total = 1 / (1 + 10 ** (ph - A.PKA_N_TERM)) - 1 / (1 + 10 ** (A.PKA_C_TERM - ph))
        return total + sum(1 / (1 + 10 ** (ph - A.PKA_POSITIVE[a])) if a in A.PKA_POSITIVE else -1 / (1 + 10 ** (A.PKA_NEGATIVE[a] - ph)) for a in s if a in A.PKA_POSITIVE or a in A.PKA_NEGATIVE)

    check(of("charge"), "charge_net_charge_ph7p0", net)
    check(of("charge"), "charge_local_max_ph7p0", lambda s: max(net(w) / 5 for w in windows(s, 5)) if len(s) >= 5 else NAN)
    check(of("charge"), "charge_cterm_net_ph7p0", lambda s: net(s[-10:]))
    check(of("global_basic"), "global_basic_shannon_entropy", entropy)
    check(of("global_basic"), "global_basic_linguistic_complexity_k2", lambda s: len(set(windows(s, 2))) / min(len(s) - 1, 400) if len(s) > 1 else NAN)
    boman = of("global_basic")[SEQS.index("FLPVLAGLTPSIVPKLVCLLTKKC")].global_basic_boman_index
    assert abs(boman + 1.235833) < 1e-6
    check(of("terminal"), "terminal_nterm5_hydropathy_mean", lambda s: np.mean([A.HYDROPATHY[a] for a in s[:5]]) if s else NAN)
    check(of("aaindex"), "aaindex_KYTJ820101_median", lambda s: np.median([A.HYDROPATHY[a] for a in s]) if s else NAN)


def test_patterns(table, of):
    import re

    for name, p in (("basic_pair", "KR|RK|KK|RR"), ("ser_thr_patch", "[ST]{3,}"), ("aromatic_pair", "[FWYH]{2,}")):
        starts = lambda s: [m.start() + 1 for m in re.finditer(p, s)]
        check(of("user_regex"), f"user_regex_{name}_count", lambda s: len(starts(s)))
        check(of("user_regex"), f"user_regex_{name}_first_pos", lambda s: starts(s)[0] if starts(s) else NAN)
        check(of("user_regex"), f"user_regex_{name}_last_pos", lambda s: starts(s)[-1] if starts(s) else NAN)
    check(of("pattern"), "pattern_ser_thr_rich_4plus_count", lambda s: len(re.findall("(?:[ST].*){4,}", s)))
    both = REGISTRY["user_regex"](patterns={"any": "A.A|K(?P<x>K)", "pair": "KK"}, overlapping=True)
    rows = sorted(compute(table, both).collect(), key=lambda r: int(r.id))
    check(rows, "user_regex_pair_count", lambda s: sum(w == "KK" for w in windows(s, 2)))
    check(rows, "user_regex_pair_last_pos", lambda s: s.rfind("KK") + 1 if "KK" in s else NAN)


#: Some mean the same in Java, some differ in syntax (nested brackets, &&, \\Z), some only Python has.
ODD = ["(K)?A(?(1)C|D)", "(?<=K)A", "(?<![KA])C", "[A[]", "[K&&R]K", "[^ACDEFGHIKLMNPQRSTVW]", "[A-F]{2}", r"(?P<a>[KR])(?P=a)", r"(.)\1", "K*", "^A|D$", r"C\Z", "(?i)kr|a[c-e]", "(?i:k)A", "(?x) K  K # two", r"\w\d?A", "(?:AC|A)(?:CD|D)", "(?>A+)A", "A++K", "A+?K", "b|Z|1", "K(?#note)K", "(?:G.*){2,}", "[Kk]", "(?=KK)K", r"\bA", "A{0,1}C", "(A|AC)(C|$)"]


@pytest.mark.parametrize("overlapping", [False, True])
def test_patterns_mean_what_python_means(table, overlapping):
    import re

    from aminoframe.functions.patterns import for_java

    assert {p for p in ODD if for_java(p) is None} == {"(K)?A(?(1)C|D)", "K*", "(?i:k)A", r"\bA"}
    made = REGISTRY["user_regex"](patterns={f"p{i}": p for i, p in enumerate(ODD)}, overlapping=overlapping, terminal_window=4)
    rows = sorted(compute(table, made).collect(), key=lambda r: int(r.id))
    for i, p in enumerate(ODD):
        flags = re.match(r"(?:\(\?[a-z]+\))?", p)[0]
        search = re.compile(f"{flags}(?={p[len(flags):]}{chr(10) if '(?x)' in p else ''})" if overlapping else p)
        starts = lambda s: [m.start() + 1 for m in search.finditer(s)] if s else []  # noqa: E731, B023
        for what, plain in (("count", lambda s: len(starts(s))), ("first_pos", lambda s: starts(s)[0] if starts(s) else NAN), ("last_pos", lambda s: starts(s)[-1] if starts(s) else NAN)):
            check(rows, f"user_regex_p{i}_{what}", plain)
        for side, cut in (("n", lambda s: s[:4]), ("c", lambda s: s[-4:])):
            check(rows, f"user_regex_p{i}_{side}term_present_w4", lambda s: float(bool(s and re.search(p, cut(s)))))  # noqa: B023
    if not overlapping:
        rows = sorted(compute(table, REGISTRY["pattern"](patterns={f"p{i}": p for i, p in enumerate(ODD)})).collect(), key=lambda r: int(r.id))
        for i, p in enumerate(ODD):
            check(rows, f"pattern_p{i}_count", lambda s: len(re.findall(p, s)) if s else 0)  # noqa: B023
            check(rows, f"pattern_p{i}_cterm_present_w10", lambda s: float(bool(s and re.search(p, s[-10:]))))  # noqa: B023


@pytest.mark.parametrize("k", [1, 3, 5, 40])
def test_word_maps(table, k):
    from aminoframe.plans.engine import kmer_maps

    found = kmer_maps(table, k)
    rows = {int(r.id): r for r in found.collect()}
    for i, s in enumerate(CLEAN):
        want = Counter(windows(s, k))
        assert rows[i].kmers == want and rows[i].total_kmers == want.total() and rows[i].unique_kmers == len(want)
    one = kmer_maps(table.sparkSession.range(2).selectExpr("cast(id as string) id", "'ACDACD' sequence"), 2)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="1 or more"):
        kmer_maps(table, 0)


def test_parameters(table):
    out = compute(table, REGISTRY["charge"](ph_values=(7.4,)))
    assert "charge_net_charge_ph7p4" in out.columns and "charge_net_charge_ph7p0" not in out.columns
    assert "sliding_window_win3_entropy_mean" in compute(table, REGISTRY["sliding_window"](window_sizes=(3,))).columns
    some = REGISTRY["autocorrelation"](scales={"own": {"A": 1.0, "K": 2.0}}, lags=(1,))
    rows = sorted(compute(table, some).collect(), key=lambda r: int(r.id))
    check(rows, "autocorrelation_mb_own_lag1", lambda s: (lambda v: float(np.mean(v[:-1] * v[1:])) if len(v) > 1 else NAN)(np.array([{"A": 1.0, "K": 2.0}[a] for a in s if a in "AK"])))
    with pytest.raises(ValueError, match="codes"):
        REGISTRY["aaindex"](codes=("NOPE",))
    with pytest.raises(ValueError, match="no value"):
        REGISTRY["pseaac"](properties={"x": {"A": 1.0}})
    with pytest.warns(UserWarning):
        REGISTRY["kmer_full_alphabet"](k=4)


def test_merge_and_pruning(table):
    out = compute(table, make(["aac", "charge"]))
    assert out.columns[:3] == ["id", "length", "valid_residue_count"] and "charge_length" not in out.columns
    assert "valid_residue_count" not in compute(table, make(["grouped", "aac"])).columns
    one = compute(table, make(["sliding_window"])[0], features=["sliding_window_win5_hydropathy_max"])
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "win9" not in plan and one.columns == ["id", "sliding_window_win5_hydropathy_max"]
    assert "Exchange" not in compute(table.sparkSession.range(3).selectExpr("cast(id as string) id", "'ACD' sequence"), make(["spacing"])[0])._jdf.queryExecution().executedPlan().toString()
    assert compute(table.limit(0), make(["aac"])[0]).count() == 0


def test_words_of_an_id_in_several_rows_are_added_up(spark):
    rows = [("a", "ACAC"), ("a", "CACK"), ("a", None), ("b", "KKK"), (None, "AC"), (None, "ACA"), ("c", ""), ("d", "A")]
    made = long_kmers(spark.createDataFrame(rows, "id string, sequence string"), 2)
    want = Counter((i, w) for i, s in rows for w in windows(s or "", 2))
    found = [tuple(r) for r in made.collect()]
    assert len(found) == len(want) and {(i, w): n for i, w, n in found} == want


def test_words_are_counted_before_they_become_rows(spark):
    made = long_kmers(spark.createDataFrame([(str(i), "ACDEF" * 2000) for i in range(4)], "id string, sequence string"), 3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and made.count() == 20
