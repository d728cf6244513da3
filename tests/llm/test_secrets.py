import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from daytide.llm import secrets
from tests.llm.helpers import documents


def base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def entropy(part):
    return -sum(c / len(part) * math.log2(c / len(part)) for c in Counter(part).values())


def added(text, window=20):
    """Windows counted afresh, for the default classes and allow-list."""
    out, text = [], text or ""
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{window},}}", text):
        run = m[0]
        if any(re.search(p, run) for p in secrets.ALLOW):
            continue
        for kind, ok, fold, bits, rank in (
            ("entropy_hex", re.fullmatch("[0-9A-Fa-f]+", run) and re.search("[0-9]", run) and re.search("[A-Fa-f]", run), True, 2.9, 3),
            ("entropy_base64", all(re.search(p, run) for p in ("[0-9]", "[a-z]", "[A-Z]")), False, 3.7, 4),
        ):
            chars = run.lower() if fold else run
            dense = [i for i in range(len(run) - window + 1) if entropy(chars[i : i + window]) >= bits - 1e-9]
            if ok and dense:
                span = (m.start() + dense[0], rank, m.start() + dense[-1] + window, kind)
                if not any(b[0] <= span[0] and span[2] <= b[2] for b in base(text)):
                    out.append(span)
    return out


def random_text(rng):
    letters = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", "ab", "0123456789ABCDEFabcdef"]
    out = []
    for _ in range(rng.randint(0, 12)):
        pick = rng.random()
        if pick < 0.5:
            out.append("".join(rng.choice(rng.choice(letters[:3] if pick < 0.2 else letters)) for _ in range(rng.randint(1, 70))))
        elif pick < 0.75:
            out.append(rng.choice(["Password", "api_key", "TOKEN", "secret'"]) + rng.choice([" = ", ":", '="']) + "".join(rng.choice(letters[1]) for _ in range(rng.randint(3, 12))))
        elif pick < 0.85:
            out.append("AKIA" + "".join(rng.choice("ABCXYZ0189") for _ in range(rng.randint(10, 20))))
        else:
            out.append(rng.choice(["grüße", "🙂🙂", "word", "x\ny"]))
    return rng.choice([" ", "\n", " ü "]).join(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, random_text(rng)) for i in range(250)]
    got = {r.doc_id: r for r in secrets.scan(documents(spark, rows)).collect()}
    kinds = Counter()
    for d, t in rows:
        assert [(s.start, s.rank, s.end, s.kind) for s in got[d].base] == base(t)
        want = sorted(base(t) + added(t))
        assert [(s.start, s.rank, s.end, s.kind) for s in got[d].spans] == want, t
        kinds.update(s[3] for s in want)
    assert set(kinds) == set(secrets.KINDS)


def test_edges(spark):
    many = " ".join("token=abcdefgh" for _ in range(3000)) + " é " + "0123456789abcdef" * 3
    rows = [(1, None), (1, None), (None, "token=abcdefgh"), (2, ""), (3, many), (3, many), (4, "token=abc")]
    got = secrets.scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (d, t) in zip(got, rows):
        assert r.doc_id == d and [(s.start, s.rank, s.end, s.kind) for s in r.base] == base(t)
    assert secrets.scan(documents(spark, [])).collect() == []


def test_redact_masks_the_union(spark):
    text = 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" é b'
    df = documents(spark, [(1, text), (2, "clean"), (3, None)])
    got = secrets.redact(df)
    assert got.columns == df.columns
    assert [r.text for r in got.orderBy("doc_id").collect()] == ['a [SECRET]" é b', "clean", None]


def test_redact_masks_what_is_dense_beside_an_allowed_part(spark):
    key, more = "aB3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xYzAbCdEfQ", "Zq9Xw7Vb5Nm3Lk1Jh2Gf4Ds6"
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [f"see com/sample-app/{key} é", f"é {key}AAAAAAAA{more}. b", f"a {alphabet} b", "no example here        x", None]
    got = secrets.redact(documents(spark, list(enumerate(texts)))).orderBy("doc_id")
    out = [r.text for r in got.collect()]
    assert key[:30] not in out[0] and "see com/sample" in out[0] and out[0].endswith("[SECRET] é")
    assert out[1] == "é [SECRET]AAAAAAAA[SECRET]. b"
    assert out[2:] == texts[2:]


def test_no_python_in_the_plan(spark):
    plan = secrets.scan(documents(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_running_sums_of_long_arrays(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(2000)).cast("array<int>").alias("x"))
    got = df.select(secrets._running(F.col("x")).alias("s")).first().s
    assert got == [n * (n + 1) // 2 for n in range(1, 2001)]
