import hashlib
import random
import re

from pyspark.sql import functions as F

from branchwise.llm import secret_scan as S


def brute(text):
    """(start, rank, kind, end) by finditer and a loop over all pairs of a text."""
    text = text or ""
    breaks = [m.end() for m in re.finditer(S.BREAK, text)]
    parts = []
    for rank, (kind, (pattern, role)) in enumerate(S.KINDS.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            if kind == "assign" and len(m[2]) < 6:
                continue
            parts.append((m.start(), rank, kind, m.end(), role, sum(b <= m.start() for b in breaks)))
    base = [p for p in parts if p[2] in S.BASE]
    weak = [p for p in parts if p[2] not in S.BASE and not any(b[0] < p[3] and p[0] < b[3] for b in base)]
    every = base + weak

    def has(p, role):
        return any(q[4] == role and q[5] == p[5] for q in every)

    return sorted(p[:4] for p in base + [p for p in weak if all(has(p, need) for need in S.NEEDS[p[4]])])


def digest(found, kinds=None):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in found if kinds is None or k in kinds)


def texts():
    rnd = random.Random(8)
    bits = ["password=abc", 'token = "0123456789abcdef0123456789abcdef"', "Api_Key: x1y2z3", "AKIA" + "Q7" * 8, "AKIASHORT", "f" * 30, "deadbeef",
            "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "user: bob", "pwd=hunter22", "https://db.example.com/x", "host = db.internal.net",
            "token=secret=abcdef", "token=token:abcdefgh", "\n", "\n\n", "\n \t\n", "é𝄞", "plain words", "x " * 150, "ſecret=longvalue", "PASSWD='q.w-e_r'"]
    out = [None, "", "\n\n", "password=", "secret:abcdef" * 3]
    for _ in range(250):
        out.append(rnd.choice([" ", "", "  "]).join(rnd.choices(bits, k=rnd.randint(1, 12))))
    return out + [("password=abcdef " + "lorem ipsum " * 20) * 400]


def test_spans_against_brute_force(spark):
    every = texts()
    rows = [(i if i % 9 else None, t, 1, "x") for i, t in enumerate(every)] + [(3, "AKIA" + "A" * 16, 1, "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, found int, key string").repartition(4)
    got = S.scan(df.withColumn("copy", F.col("text"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(x) for x in r.found] == brute(r.copy), r.copy


def test_scopes_are_bounded_by_form_alone(spark):
    jwt = "eyJ" + "Q-z" * 299
    far = "filler, " * 5000
    linked = [f"auth: {jwt}\nuser: bob", f"user: bob {far} pwd=hunter22", '{"user": "bob", "note": "%s", "pwd": "hunter22"}' % far,
              f"user: bob\n{far}\nauth: {jwt}\nhttps://h.example.com/x"]
    apart = [f"user: bob\n \nauth: {jwt}", "The user: bob is here. Now pwd=hunter22 is there", 'They said "user: bob." Éric has pwd=hunter22',
             '[{"user": "bob"}, {"pwd": "hunter22"}]', "user: bob \n\n" * 300 + "nothing https://h.example.com/x"]
    every = linked + apart
    df = spark.createDataFrame([(i, t) for i, t in enumerate(every)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: [tuple(x) for x in r.found] for r in S.scan(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(every)}
    assert [len(got[i]) for i in range(len(every))] == [2, 2, 2, 3, 0, 0, 0, 0, 0]
    clear = {r.doc_id: r.text for r in S.mask(df).collect()}
    assert clear[0] == "[redacted]\n[redacted]" and clear[4] == apart[0] and far in clear[1]


def test_a_million_characters_of_each_repeating_part(spark):
    n = 1_000_000
    every = ["password=" + "g" * n, "AKIA" + "Q" * n, "f" * n, "Aa1" * (n // 3), "user=bob pwd=" + "x" * n, "pwd=hunter22 user=" + "b." * (n // 2),
             "user=bob pwd=hunter22 host=a" + ".a" * (n // 2), "user=bob pwd=hunter22 https://" + "a/" * (n // 2), "\n " * (n // 2), ". " * (n // 2),
             "}, {" * (n // 4), "." + "'" * n, "token" + " " * n, "user" * (n // 4), "https://" * (n // 8), "=:" * (n // 2), "." + " " * n]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(every)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: [(x["kind"], x["end"] - x["start"]) for x in r.found] for r in S.scan(df).collect()}
    assert got[0] == [("assign", n + 9)] and got[1] == [("access", n + 4)] and got[2] == [("hex", n)]
    assert [k for k, _ in got[4]] == ["ident", "value"] and [k for k, _ in got[6]] == ["ident", "value", "endpoint"]
    assert got[6][2][1] == n + 6 and [k for k, _ in got[7]] == ["ident", "value", "endpoint"]
    assert all(not got[i] for i in (3, 8, 9, 10, 11, 12, 13, 14, 15, 16))


def test_mask_leaves_nothing_and_keeps_the_rest(spark):
    every = texts()
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(every)], "doc_id long, text string, key string")
    got = {r.doc_id: r.text for r in S.mask(df).collect()}
    assert len(got) == len(every)
    for i, t in enumerate(every):
        want, at = "", 0
        merged = []
        for s, _, _, e in brute(t):
            if merged and merged[-1][1] > s:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in merged:
            want, at = want + t[at:s] + "[redacted]", e
        assert got[i] == (None if t is None else want + t[at:])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.scan(df).count() == 0 and S.mask(df).count() == 0


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = S.op6_secret_scan(spark, sf).collect()
    assert len(got) == len(docs) and sum(r.n_assign + r.n_access for r in got) > 10
    for r in got:
        found = brute(docs[r.doc_id])
        assert r.spans == digest(found)
        assert r.base_sha256 == hashlib.sha256(digest(found, S.BASE).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[2] == k for f in found) for k in S.BASE)
