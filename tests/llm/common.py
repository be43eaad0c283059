"""Small tables that hold the awkward cases."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def awkward(seed=5, n=60):
    """Documents with nulls, blanks, copies, near copies, shared passages, long runs and one long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    make = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, rows = make(70), []
    for i in range(n):
        kind = i % 10
        text = make(r.randint(20, 160))
        if kind == 1 and i > 10:
            text = rows[r.randrange(len(rows))][1].split() or ["x"]
        elif kind == 2 and i > 10:
            text = list(rows[(i * 7) % len(rows)][1].split())
            for _ in range(max(1, len(text) // 40)):
                if text:
                    text[r.randrange(len(text))] = r.choice(vocab)
        elif kind == 3:
            text = text[:10] + passage + text[10:30]
        elif kind == 4:
            text = ["same"] * r.randint(40, 130)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(text).title() if kind == 5 else " ".join(text)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "One"), (n + 5, "a b c d"), (n + 6, " ".join(make(6000)))]
    return [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", None]), len(t or "")) for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    """df with further columns of names that operators use themselves."""
    for name in names:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df
