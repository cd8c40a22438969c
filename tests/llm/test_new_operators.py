"""Url verdicts, spelling variants and the filter audit against plain versions."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablepact.llm.audit import interactions, intervals, masks, orders
from tablepact.llm.common import materialized
from tablepact.llm.reputation import Limits, Rule, beta_cdf, host_of, judged_urls, path_of, reputations, suffix_and_domain
from tablepact.llm.spelling import Acceptor, near_pairs, variant_groups, vocabulary

RNG = random.Random(11)


# -- urls ----------------------------------------------------------------------


def test_beta_cdf_equals_its_integral():
    for a, b, x in [(0.3, 0.2, 0.5), (2, 7, 0.25), (40, 60, 0.5), (500.5, 300.5, 0.6), (20000, 20100, 0.5)]:
        log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
        # The midpoint rule; below 1 over u = t ** a, which takes the pole at 0 away.
        p = min(a, 1)
        t = ((np.arange(400_000) + 0.5) / 400_000 * x**p) ** (1 / p)
        part = np.exp((a - p) * np.log(t) + (b - 1) * np.log1p(-t) - log_beta).mean() * x**p / p
        assert beta_cdf(x, np.array([a]), np.array([b]))[0] == pytest.approx(part, rel=2e-5, abs=1e-9)
    assert beta_cdf(0.5, np.array([]), np.array([])).tolist() == []


def pages_of(spark, rows):
    frame = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean")
    return materialized(frame.withColumns({"host": F.lit("mine"), "judged": F.lit(1), "_host": F.lit(2)}), "pages")


def plain_rates(rows, limits):
    """Shrunk means by host, level by level, in plain Python."""
    hosts = collections.defaultdict(lambda: [0, 0])
    for host, bad in rows:
        hosts[host][0] += bad is not None
        hosts[host][1] += bool(bad)
    domain = {h: ".".join(h.split(".")[-2:]) for h in hosts}
    suffix = {h: h.split(".")[-1] for h in hosts}

    def summed(names):
        out = collections.defaultdict(lambda: [0, 0])
        for h, name in names.items():
            out[name][0] += hosts[h][0]
            out[name][1] += hosts[h][1]
        return out

    def strength(groups, above):
        seen = [(n, k, above[g]) for g, (n, k) in groups.items() if n]
        free = sum(n - 1 for n, _, _ in seen)
        usual, least, most = limits.spread
        excess = sum(n * (k / n - m) ** 2 / (m * (1 - m)) for n, k, m in seen)
        return 1 / (min(most, max(least, (excess - len(seen)) / free)) if free else usual) - 1

    weight = sum(n for n, _ in hosts.values()) + 1
    overall = (sum(k for _, k in hosts.values()) + 0.5) / weight
    means = None
    for groups, parent in ((summed(suffix), None), (summed(domain), {domain[h]: suffix[h] for h in hosts}), (hosts, domain)):
        above = {g: overall if parent is None else means[parent[g]] for g in groups}
        known = {g: weight if parent is None else sum(both[parent[g]]) for g in groups}
        s = strength(groups, above)
        own = {g: 1 / (1 / (s + 1) + 1 / (known[g] + 1)) - 1 for g in groups}
        both = {g: (own[g] * above[g] + k, own[g] * (1 - above[g]) + n - k) for g, (n, k) in groups.items()}
        means = {g: a / (a + b) for g, (a, b) in both.items()}
    return both


def test_reputations_equal_plain_ones(spark):
    hosts = [f"{a}.{b}.{c}" for a in "abcd" for b in ("one", "two", "three") for c in ("com", "net")]
    rate = {h: RNG.choice([0.05, 0.1, 0.9]) for h in hosts}
    rows = [(h, None if RNG.random() < 0.3 else RNG.random() < rate[h]) for h in RNG.choices(hosts, k=900) + ["new.one.com", "alone.org"]]
    frame = pages_of(spark, [(i, f"http://{h}/x", bad) for i, (h, bad) in enumerate(rows)])
    want = plain_rates(rows, Limits())
    got = {r.host: r for r in reputations(frame).collect()}
    assert set(got) == set(want)
    for host, (a, b) in want.items():
        assert got[host].mean == pytest.approx(a / (a + b), rel=1e-9)
        assert got[host].p_above == pytest.approx(1 - beta_cdf(0.5, np.array([a]), np.array([b]))[0], abs=1e-9)
    judged, j = judged_urls(frame, (Rule("allow", "a.one.com/x"),))
    verdicts = {r[j].host: r[j].verdict for r in judged.collect()}
    many = collections.Counter(h for h, bad in rows if bad is not None)
    assert all(verdicts[h] == "block" for h in hosts if rate[h] == 0.9 and many[h] > 20 and h != "a.one.com")
    assert verdicts["a.one.com"] == "allow" and all(verdicts[h] == "allow" for h in hosts if rate[h] < 0.5)


def test_hosts_paths_and_domains(spark):
    urls = [None, "", "no scheme", "http://A.b.CO.uk:80/p/q?r#s", "x://://y", "http://h?q=://z/", "https://Ärger.de#f", "http://10.0.0.1/a", "http://localhost", "ftp://a.b.c./d"]
    frame = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    host = host_of(F.col("url"))
    suffix, domain = suffix_and_domain(host)
    got = [tuple(r) for r in frame.select("i", host, path_of(F.col("url")), suffix, domain).orderBy("i").collect()]
    assert [g[1:] for g in got] == [
        ("", "", "", ""), ("", "", "", ""), ("", "", "", ""), ("a.b.co.uk:80", "/p/q", "co.uk", "b.co.uk"), (":", "//y", "", ""), ("h", "", "h", "h"),
        ("Ärger.de", "", "de", "Ärger.de"), ("10.0.0.1", "/a", "10.0.0.1", "10.0.0.1"), ("localhost", "", "localhost", "localhost"), ("a.b.c.", "/d", "c", "b.c")]


def test_rules_and_awkward_pages(spark):
    rules = [Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("allow", "a.example.org/"), Rule("block", "example.org/en/1")]
    urls = [None, "nothing", "http://x.example.org/es/1", "http://example.org/en/12?p", "http://a.example.org/es/1", "http://notexample.org", "http://notexample.org/", "http://a.example.org/e"]
    frame = pages_of(spark, [(i, u, None) for i, u in enumerate(urls)] + [(2, urls[2], None), (None, urls[3], True)])
    judged, j = judged_urls(frame, rules)
    assert j == "judged_" and judged.columns == [*frame.columns, j]
    found = sorted((str(r.page_id), str(r[j].rule), r[j].verdict) for r in judged.collect())
    assert found == sorted([("0", "None", "allow"), ("1", "None", "allow"), ("2", "example.org/es/", "block"), ("2", "example.org/es/", "block"),
                            ("3", "example.org/en/1", "block"), ("4", "example.org/es/", "block"), ("5", "None", "allow"), ("6", "org/", "allow"),
                            ("7", "a.example.org/", "allow"), ("None", "example.org/en/1", "block")])
    empty, _ = judged_urls(frame.where("false"), rules)
    assert empty.isEmpty()
    unlabelled, j = judged_urls(pages_of(spark, [(1, "http://a.b/c", None)]))
    assert unlabelled.first()[j].verdict == "allow" and unlabelled.first()[j].mean == pytest.approx(0.5)
    with pytest.raises(ValueError):
        Rule("allow", "no-path")


# -- spelling ------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_acceptor_is_minimal_and_accepts_its_words():
    for _ in range(50):
        words = sorted({"".join(RNG.choices("ab", k=RNG.randint(0, 5))) for _ in range(RNG.randint(1, 20))})
        acceptor = Acceptor(words)

        def language(state):
            found = [""] if acceptor.final[state] else []
            return frozenset(found + [s + rest for s, t in acceptor.arcs[state].items() for rest in language(t)])

        assert sorted(language(acceptor.start)) == words
        assert len({language(s) for s in range(len(acceptor.arcs))}) == len(acceptor.arcs)


def test_composition_finds_each_pair_once():
    for _ in range(100):
        length = RNG.randint(1, 5)
        words = sorted({"".join(RNG.choices("abc", k=length - RNG.randint(0, 1))) for _ in range(RNG.randint(1, 25))})
        found = [tuple(sorted(p)) for p in near_pairs(words, "", length)]
        assert len(found) == len(set(found))
        assert set(found) == {tuple(sorted(p)) for p in itertools.combinations(words, 2) if one_edit(*p) and max(map(len, p)) == length}


def plain_groups(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return sorted(rows, key=str)


@pytest.mark.parametrize("most", [3, 20_000])
def test_groups_equal_brute_force(spark, most):
    words = {"".join(RNG.choices("abé", k=RNG.randint(7, 9))) for _ in range(250)} | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "a" * 40, "a" * 41, "b" + "a" * 40}
    counts = {w: RNG.choice([2, 3, 5, 30, 70, 900, 12_000]) for w in sorted(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = sorted((tuple(r) for r in variant_groups(frame, most=most).collect()), key=str)
    assert found == plain_groups(counts)
    assert any(form and root != form for _, _, _, form, _, root in found)


def test_vocabulary(spark):
    texts = ["Hyperion hyperion HYPERION shortly", "ÀÉÎÕÜßç ÀÉÎÕÜßç àéîõüßç", None, "", "a" * 30_000 + " " + "a" * 30_000, "don't_hyperion9hyperion", "abcdefg×hijklmn ÷", "東京hyperions東京"]
    rows = [(i * 37, RNG.choice(texts)) for i in range(400)] + [(None, texts[0]), (5, texts[1]), (5, texts[1])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "run": F.lit(2)})
    count = collections.Counter()
    letters = set(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))
    upper = {c: c + 32 for c in range(65, 91)}
    for i, text in rows:
        for run in "".join(c if c in letters else " " for c in text or "").split(" "):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0 and run:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                count[run] += 1
    got = dict(tuple(r) for r in vocabulary(frame, altered=31).collect())
    assert got == {w: n for w, n in count.items() if n >= 2} and len(got) > 4
    assert variant_groups(vocabulary(frame.where("false"), altered=31)).isEmpty()


# -- the audit of filters ------------------------------------------------------


def test_intervals_are_those_of_the_orders():
    every = orders()
    assert every == sorted(every) and len(every) == 120
    covered = collections.Counter()
    for mask, step, begin, after in intervals():
        for rank in range(begin, after):
            covered[mask, step, rank] += 1
    expected = set()
    for mask in range(1, 32):
        for rank, order in enumerate(every):
            expected.add((mask, next(s for s, f in enumerate(order, 1) if mask >> "ABCDE".index(f) & 1), rank))
    assert set(covered) == expected and set(covered.values()) == {1}


def plain_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = collections.defaultdict(list)
    for i, text, part in rows:
        t = text or ""
        words = t.encode().split()
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        docs[part or ""].append((i, {f for f, yes in fails.items() if yes}))
    out = []
    for part, own in docs.items():
        shapley, found = collections.Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(removed)
                failing = sum(f in d[1] for d in own)
                found.append((part, order, step, len(left), len(removed), failing - len(removed), sum(d[1] == {f} for d in own),
                              sum(d[0] in good for d in removed), sum(d[0] in toxic for d in removed), f))
        out += [(*x[:-1], shapley[x[-1]]) for x in found]
    return sorted(out)


def test_audit_equals_applying_every_order(spark):
    def text():
        words = ["".join(RNG.choices("abcdeAB", k=3)) for _ in range(RNG.choice([5, 60, 220]))]
        return " ".join(words if RNG.random() < 0.5 else words[:20] * 11) + RNG.choice(["", " #", "\n"])

    bodies = [text() for _ in range(25)] + [None, "", " \t", "x " * 300, "word " * 30_000]
    rows = [(i, RNG.choice(bodies), RNG.choice(["en", "de", "", None])) for i in range(300)]
    rows += [(None, bodies[0], "en"), (None, None, None), (7, rows[7][1], "en"), (7, rows[7][1], "en"), rows[3], (-1, bodies[1], "fr")]
    labels = [(RNG.randrange(300), RNG.choice([0, 1, None]), RNG.choice([0, 1, None])) for _ in range(200)] + [(None, 1, 1)]
    docs = materialized(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns(
        {c: F.lit(c) for c in ("part", "mask", "id", "deal", "digest", "n", "quality", "toxic")}), "docs")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("x"))
    found = interactions(masks(docs, marks))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, labels)
    assert interactions(masks(docs.where("false"), marks)).isEmpty()
    assert interactions(masks(docs, marks.where("false"))).where("good_lost + toxic_lost > 0").isEmpty()
