import random

from tablewright.llm import urls

CAPTURES = "page_id long, url string, day long, `list` string, `key` string, host string"
ENTRIES = "list string, key string, action string, day long"


def brute_verdict(url, day, entries):
    if day is None or abs(day) > urls.LAST_DAY or not url or "://" not in url:
        return 0, "", "keep"
    rest = url.split("://", 1)[1]
    host, _, path = rest.partition("/")
    host = host.split("@")[-1].split(":")[0].split("?")[0].split("#")[0].lower().rstrip(".")
    parts = [p for p in path.split("?")[0].split("#")[0].split("/") if p]
    labels = host.split(".")
    keys = [".".join(labels[i:]) for i in range(len(labels))] + [f"{host}/" + "/".join(parts[:n]) for n in range(1, len(parts) + 1)]
    active = []
    for name in {e[0] for e in entries if e[0]}:
        for key in keys:
            state = None
            for _, _, action, when in sorted((e for e in entries if e[0] == name and e[1] == key and e[3] is not None and e[2] in ("add", "remove")), key=lambda e: (e[3], e[2])):
                if when <= day:
                    state = action
            if state == "add":
                active.append((len(key), name == "allow", name, key))
    if not active:
        return 0, "", "keep"
    best = max(active)
    return len(active), f"{best[2]}:{best[3]}", "keep" if best[1] else "drop"


def check(spark, captures, entries):
    df = spark.createDataFrame([(*c, "x", "y", "z") for c in captures], CAPTURES)
    got = urls.judged(df, spark.createDataFrame(entries, ENTRIES)).collect()
    want = [(i, day, *brute_verdict(url, day, entries)) for i, url, day in captures]
    assert sorted(((r.page_id, r.day, r.n_active, r.decided_by, r.verdict) for r in got), key=repr) == sorted(want, key=repr)


def test_equals_brute_force_with_a_hot_host(spark, monkeypatch):
    monkeypatch.setattr(urls, "HOT", 5)
    monkeypatch.setattr(urls, "PERIOD", 16)
    rng = random.Random(2)
    hosts = ["hot.example.org", "a.example.org", "b.example.com", "Example.ORG", "user@c.example.net:8080"]
    captures = [(i, f"https://{hosts[0] if rng.random() < 0.5 else rng.choice(hosts)}/{rng.choice(['', 'x', 'x/y', 'x/y/z', '?q', '/x//y#f'])}", rng.randrange(300)) for i in range(300)]
    keys = ["hot.example.org", "example.org", "org", "hot.example.org/x", "hot.example.org/x/y", "hot.example.org/x/y/z", "b.example.com", "c.example.net/x"]
    entries = [(rng.choice(["block", "allow", "other"]), rng.choice(keys), rng.choice(["add", "remove"]), rng.randrange(-20, 320)) for _ in range(120)]
    check(spark, captures, entries)


def test_edges(spark):
    captures = [(1, None, 5), (2, "", 5), (3, "no url", 5), (4, "http://a.b/c", None), (None, "http://a.b/c", 5), (5, "http://a.b/c", 5), (5, "http://a.b/c", 5), (6, "http://" + "l" * 90_000 + ".b/", 5)]
    entries = [("block", "a.b", "add", 5), ("block", "a.b", "add", 5), ("block", "b", "add", 1), ("block", "b", "remove", 5), (None, "a.b", "add", 1), ("block", None, "add", 1), ("block", "b", None, 1), ("block", "b", "odd", 2), ("allow", "a.b", "add", None)]
    check(spark, captures, entries)
    check(spark, captures, [])
    check(spark, [], entries)


def test_paths_of_any_depth_and_wild_days(spark):
    captures = [(1, "http://h.com/a/b/c/d", 10), (2, "http://h.com/a/b", 10), (3, "http://h.com/a/b/c", 10**15), (4, "http://h.com/a/b/c", -(10**12)), (5, "http://h.com/a/b/c", 900_000)]
    entries = [("block", "h.com/a/b/c", "add", 5), ("block", "h.com", "add", -(10**14)), ("block", "h.com", "remove", -3), ("allow", "h.com/a", "add", -(10**15)), ("allow", "h.com/a", "remove", 10**15)]
    check(spark, captures, entries)
