"""Text rules against plain-Python versions on generated strings."""

import math
import pathlib
import random
import re

from tallyspark.functions import expr as X
from tallyspark.functions import fixed

ALPHABET = list("aZ09 _-./\\") + ["\t", "\n", " ", " ", "é", "NaN", "none", "<NA>",
                                  "1e3", "+", "-", "inf", ".", "x"]


def gen(n=400, seed=11):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.randint(0, 6)
        out.append("".join(rnd.choice(ALPHABET) for _ in range(k)))
    return out + [None, "  ", " 12 ", "-0.5", "3.", ".5", "1,5", "Infinity", " nan "]


def py_number(s):
    if s is None:
        return None
    t = s.strip()
    if re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", t):
        v = float(t)
        return None if math.isnan(v) else v
    low = t.lower()
    if low in ("inf", "+inf", "infinity", "+infinity"):
        return math.inf
    if low in ("-inf", "-infinity"):
        return -math.inf
    return None


def py_safe(s):
    if s is None:
        return fixed.SAFE_NAME_DEFAULT
    t = re.sub(f"[^{fixed.SAFE_NAME_KEEP}]+", "_", s.strip()).strip("_")
    return t or fixed.SAFE_NAME_DEFAULT


def py_file_key(s):
    if s is None:
        return ""
    return pathlib.PurePosixPath(s.replace("\\", "/").strip()).name


def test_text_rules_match_python(spark):
    values = gen()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", X.strip_text("v").alias("strip"), X.missing_like("v").alias("miss"),
                     X.to_number("v").alias("num"), X.safe_name("v").alias("safe"),
                     X.file_key("v").alias("key")).orderBy("i").collect()
    for r in rows:
        v = values[r.i]
        assert r.strip == (None if v is None else v.strip()), repr(v)
        assert r.miss == (v is None or v.strip().lower() in fixed.MISSING_TOKENS), repr(v)
        expected = py_number(v)
        assert r.num == expected, repr(v)
        assert r.safe == py_safe(v), repr(v)
        assert r.key == py_file_key(v), repr(v)


def py_year(s):
    if s is None:
        return None
    m = re.search(fixed.YEAR_PATTERN, s)
    return int(m.group(1)) if m else None


def py_padded(s):
    t = s if len(s) >= fixed.UNIT_CODE_WIDTH else s.rjust(fixed.UNIT_CODE_WIDTH, "0")
    a, u = t[:fixed.UNIT_CODE_HEAD], t[fixed.UNIT_CODE_HEAD:]
    ok = re.fullmatch(r"[+-]?\d+", a) and re.fullmatch(r"[+-]?\d+", u)
    return f"{int(a)}-{int(u)}" if ok else None


def py_split(s):
    parts = s.split(fixed.ELECTION_ID_SEPARATOR)
    try:
        y = parts[0].strip()
        r = parts[2][1]
        if re.fullmatch(r"[+-]?\d+", y) and re.fullmatch(r"\d", r):
            return int(y), int(r)
    except IndexError:
        pass
    return None, None


def test_parsers_match_python(spark):
    rnd = random.Random(5)
    digits = "0123456789"
    texts = []
    for _ in range(300):
        kind = rnd.randint(0, 3)
        if kind == 0:
            texts.append("".join(rnd.choice(digits + "-_ t/") for _ in range(rnd.randint(0, 8))))
        elif kind == 1:
            texts.append(f"{rnd.randint(1990, 2030)}_{rnd.choice(['muni', 'x', ''])}_"
                         f"{rnd.choice(['t1', 't2', 'tx', 't', ''])}")
        elif kind == 2:
            texts.append(str(rnd.randint(0, 99999)))
        else:
            texts.append(f"{rnd.randint(1, 28):02d}/{rnd.randint(1, 12):02d}/{rnd.randint(1995, 2030)}")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    sk = X.split_key("v")
    pc = X.padded_code("v")
    rows = df.select("i", X.extract_year("v").alias("y"), sk["year"].alias("sy"),
                     sk["round"].alias("sr"), pc["key"].alias("pk"),
                     X.parse_date_dayfirst("v").alias("d")).orderBy("i").collect()
    import datetime as dt
    for r in rows:
        t = texts[r.i]
        assert r.y == py_year(t), t
        assert (r.sy, r.sr) == py_split(t), t
        assert r.pk == py_padded(t), t
        m = re.fullmatch(r"(\d{2})/(\d{2})/(\d{4})", t)
        if m:
            try:
                want = dt.date(int(m.group(3)), int(m.group(2)), int(m.group(1)))
            except ValueError:
                want = None
            assert r.d == want, t
