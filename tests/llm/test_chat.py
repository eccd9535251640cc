import random

from pyspark.sql import functions as F

from branchwise.llm import chat as C


def plain_parse(formatted):
    """The grammar, character by character."""
    out, segments = [], formatted.split("\n</turn>\n")
    assert segments[-1] == ""
    for s in segments[:-1]:
        assert s.startswith("### ")
        role, _, text = s[4:].partition(": ")
        assert ":" not in role
        i, got = 0, ""
        while i < len(text):
            k = i
            while k < len(text) and text[k] == "\\":
                k += 1
            control = next((c for c in ("</turn>", "### ") if text.startswith(c, k)), None)
            if control:
                assert k > i, "control string without a backslash"
                got += text[i + 1:k] + control
                i = k + len(control)
            else:
                got += text[i:k + 1]
                i = k + 1
        out.append((role.replace("%0A", "\n").replace("%3A", ":").replace("%25", "%"), got))
    return out


def test_round_trip_against_a_plain_parser(spark):
    rnd = random.Random(6)
    bits = ["</turn>", "### ", "###", "\\", "\\\\", "\n", "\n</turn>\n", "assistant: ", ":", "ok", "é𝄞", "</turn", "#", " ", "%3A", "$1"]
    rows = [(c, t, rnd.choice(["user", "assistant", "a:b\n%3A", "", None]),
             None if rnd.random() < 0.05 else "".join(rnd.choices(bits, k=rnd.randint(0, 9))), 0)
            for c in range(150) for t in range(rnd.randint(1, 6))]
    rows += [(None, 1, "assistant", "x", 0), (None, None, "user", "y", 0), (900, 1, "user", "z", 0), (900, 1, "user", "z", 0),
             (901, 1, "assistant", "</turn> \\" * 30000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(4)
    got = {r.conv_id: r for r in C.format_conversations(df).withColumn("parsed", C.parse(F.col("formatted"))).collect()}
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert plain_parse(got[c].formatted) == turns
        assert [tuple(p) for p in got[c].parsed] == turns
        masked = [got[c].formatted[s.start:s.end] for s in got[c].loss_spans]
        assert [plain_parse(f"### a: {m}\n</turn>\n")[0][1] for m in masked] == [x for role, x in turns if role == "assistant"]


def test_long_runs_of_backslashes(spark):
    n = 1_000_000
    texts = ["\\" * n, "\\" * n + "### ", "### " + "\\" * n + "</turn>", "\\" * n + "x </turn>"]
    df = spark.createDataFrame([(i, 0, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.parsed for r in C.format_conversations(df).select("conv_id", C.parse(F.col("formatted")).alias("parsed")).collect()}
    assert {c: p[0].text for c, p in got.items()} == dict(enumerate(texts))


def test_plain_text_stays_as_it_is(spark):
    df = spark.createDataFrame([(1, 0, "user", "a\\b # c\n")], "conv_id long, turn long, role string, text string")
    assert C.format_conversations(df).head().formatted == "### user: a\\b # c\n\n</turn>\n"
    assert C.format_conversations(df.limit(0)).count() == 0
