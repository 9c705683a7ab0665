import hashlib
import random

from pyspark.sql import functions as F

from tallyloom.llm import shards, url_cascade


def cascade(spark, hosts, listed, **more):
    df = spark.createDataFrame([(h, h in listed) for h in hosts], "host string, bad boolean")
    return url_cascade.build(df, "host", F.col("bad"), **more)


def test_cascade_is_exact_over_the_universe(spark):
    rng = random.Random(3)
    hosts = [f"h{rng.getrandbits(40)}.example" for _ in range(4000)]
    frame = spark.createDataFrame([(h,) for h in hosts + [None, hosts[0]]], "host string")
    for share in (0, 0.02, 0.5, 1):
        listed = set(hosts[: int(share * len(hosts))])
        for slices in (1 << 25, 200):
            if share != 0.02 and slices == 200:
                continue
            made = cascade(spark, hosts, listed, max_bytes=slices)
            got = {r.host: r.m for r in frame.withColumn("m", made.holds(F.col("host"))).where("host is not null").collect()}
            assert {h for h, m in got.items() if m} == listed
    assert len(made.levels) == 1 and cascade(spark, [], set()).levels == ((),)


def test_judge(spark):
    rules = [url_cascade.parse_rule(*r) for r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))]
    urls = {
        "http://A.Example.NET/en/x": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net": ("example.net", "", None, "allow"),
        "http://example.net/": ("example.net", "/", "net/", "block"),
        "https://badexample.com/de/1?q=/x": ("badexample.com", "/de/1", None, "allow"),
        "https://m.example.com/de/1#t": ("m.example.com", "/de/1", "example.com/de/", "block"),
        "x://org/fr/": ("org", "/fr/", "org/fr/", "allow"),
        "//no.scheme/net/": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://\nnet/\nx": ("\nnet", "/\nx", None, "allow"),
        "http://listed.org/de/?x": ("listed.org", "/de/", None, "block"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    made = cascade(spark, ["listed.org", "other.org", "", "example.net", "badexample.com"], {"listed.org"})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge(df, rules, made).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())
    assert url_cascade.judge(df.where("false"), rules, made).count() == 0


def test_more_slices_than_a_task_carries(spark, monkeypatch):
    monkeypatch.setattr(url_cascade, "SLICES", 2)
    hosts = [f"h{i}.example" for i in range(400)]
    listed = set(hosts[::7])
    urls = [f"http://{h}/a" for h in hosts] + ["http://h0.example/" + "x" * 1_000_000, "http://" + "y" * 1_000_000, "http://h0.example/a", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    made = cascade(spark, [*hosts, "y" * 1_000_000], listed, max_bytes=12)
    assert len(made.levels) > 3
    got = url_cascade.judge(df, [], made).collect()
    assert sorted(r.page_id for r in got) == list(range(len(urls)))
    assert all((r.verdict == "block") == (r.host in listed) for r in got)


def slow_shards(rows, limit):
    """Buckets split one bit at a time."""
    bits = {i: format(int(hashlib.md5(f"{'' if k is None else k}:{t or ''}".encode()).hexdigest()[:15], 16), "060b") for i, (k, t) in enumerate(rows)}
    size = {i: len((t or "").encode()) for i, (_, t) in enumerate(rows)}
    todo, out = [(0, "", list(bits))], {}
    while todo:
        d, p, own = todo.pop()
        if sum(size[i] for i in own) <= limit:
            out |= {i: (f"{d}:{p}", sum(size[j] for j in own)) for i in own}
        else:
            todo += [(d + 1, p + c, [i for i in own if bits[i][d] == c]) for c in "01" if any(bits[i][d] == c for i in own)]
    return out


def test_shards_match_splitting_one_bit_at_a_time(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.choice([0, 3, 40, 900])) for i in range(600)] + [(None, None), (None, "a"), (5, "other")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int")
    for limit in (1000, 5000, 10**9):
        got = sorted((str(r.doc_id), r.bytes, r.shard, r.shard_bytes, r.oversize) for r in shards.assign(df, limit).collect())
        want = slow_shards(rows, limit)
        assert got == sorted((str(k), len((t or "").encode()), *want[i], False) for i, (k, t) in enumerate(rows))
    assert shards.assign(df.where("false"), 10).count() == 0


def test_only_oversized_buckets_split(spark):
    rows = [(0, "x" * 20_000_000)] + [(i, "y" * 100) for i in range(1, 399)]
    got = shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), 100_000).collect()
    large = next(r for r in got if r.doc_id == 0)
    assert large.oversize and large.depth == shards.BITS
    small = {r.shard: r.depth for r in got if r.doc_id}
    # The small rows would fit one shard: they are parted only along the large one's bits.
    assert len(small) <= 12 and sorted(small.values())[:3] == [1, 2, 3]
    want = slow_shards(rows[1:], 100_000)
    assert {s for s, _ in want.values()} == {"0:"}


def test_rows_alike_and_rows_too_large(spark):
    rows = [(1, "y" * 100)] * 95 + [(2, "z" * 5000), (3, "a")]
    got = shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()
    assert len(got) == len(rows)
    sums = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.bytes
    assert all(sums[r.shard] == r.shard_bytes and (r.shard_bytes <= 1000 or r.oversize) for r in got)
    assert [r.doc_id for r in got if r.oversize] == [2]
