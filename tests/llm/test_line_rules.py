import random
import re
from collections import Counter, defaultdict

from newsloom.llm import line_rules as lr

def letters(*n):
    """A word that tells numbers apart without digits, which lines' normal form levels."""
    return "".join(f"x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in n)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, max_docs, max_lost, copies=90):
    def norm(line):
        return " ".join(WORD.findall(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line))))

    def lines(text):
        return [x for x in (text or "").split("\n") if WORD.search(x)]

    def words_in(text, found):
        return sum(len(WORD.findall(x)) for x in lines(text) if norm(x) in found)

    documents = set(rows)
    held = defaultdict(set)
    for row in documents:
        for line in lines(row[1]):
            held[row[2], norm(line)].add(row)
    above = defaultdict(set)
    for (source, line), d in held.items():
        if len(d) > max_docs:
            above[source].add(line)
    depleted = {d for d in documents if words_in(d[1], above[d[2]]) * 100 > len(WORD.findall(d[1] or "")) * max_lost}
    removed = {source: {x for x in found if len(held[source, x] & depleted) * 100 < len(held[source, x]) * copies} for source, found in above.items()}
    out = []
    for i, text, source in rows:
        text = text or ""
        w = WORD.findall(text)
        runs = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = set()
        for j in range(len(w) - 7):
            if runs[tuple(w[j : j + 8])] > 1:
                cover.update(range(j, j + 8))
        lost = words_in(text, removed[source])
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines(text)) - len(set(lines(text))), len(cover), failed, not failed and lost * 100 <= len(w) * max_lost, lost))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(200)] + ["é#", "<b>", "x\x0b", "🎉"]
    boiler = [" ".join(r.choice(words) for _ in range(r.randint(1, 12))) for _ in range(5)]
    rows = []
    for _ in range(120):
        lines = []
        for _ in range(r.randint(0, 8)):
            line = r.choice(boiler) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(r.randint(0, 30)))
            lines.append(line.upper() if r.random() < 0.1 else line)
            if r.random() < 0.1:
                lines.append(line)
        rows.append((len(rows), "\n".join(lines), r.choice(["a", "b", None])))
    rows += [(len(rows), None, "a"), (len(rows) + 1, "", None), (len(rows) + 2, "again " * 4000, "b")]
    return rows + rows[:3]


def test_equals_brute_force(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, source string, key int, host string")
    got = [tuple(r) for r in lr.line_rules(df, max_docs=4, max_lost=50).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words").collect()]
    assert sorted(got) == sorted(brute(rows, 4, 50))
    assert any(x[-1] for x in got) and any(not x[6] and not x[7] for x in got)


def test_apply_keeps_columns_and_removes_lines(spark):
    rows = corpus(6)
    df = spark.createDataFrame([(*x, len(x[1] or ""), "y") for x in rows], "doc_id long, text string, source string, n_chars long, key string")
    verdict = brute(rows, 4, 50)
    out = lr.apply_line_rules(df, max_docs=4, max_lost=50)
    assert out.columns == df.columns
    got = sorted((r.doc_id, r.n_chars == len(r.text), len(WORD.findall(r.text))) for r in out.collect())
    assert got == sorted((v[0], True, v[1] - v[-1]) for v in verdict if v[7])


def test_copies_are_no_boilerplate(spark):
    """150 documents of one text: all counted, none depleted; the same line beside other text leaves."""
    text = "\n".join(" ".join(letters(1, i, j) for j in range(9)) for i in range(6))
    rows = [(i, text, "a") for i in range(150)] + [(1000 + i, text.split("\n")[0] + "\n" + " ".join(letters(2, i, j) for j in range(40)), "a") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r.kept and (r.lost_words == 9 or r.doc_id < 1000) for r in lr.line_rules(df).collect())
    alone = spark.createDataFrame(rows[:150], df.schema)
    assert {(r.kept, r.lost_words) for r in lr.line_rules(alone).collect()} == {(True, 0)}


def test_pages_of_boilerplate_alone_go(spark):
    menu = "\n".join(" ".join(letters(3, i, j) for j in range(9)) for i in range(4))
    rows = [(i, menu + "\n" + " ".join(letters(2, i, j) for j in range(40)), "a") for i in range(130)] + [(200 + i, menu + "\npage " + letters(7, i), "a") for i in range(10)]
    got = {r.doc_id: r.text for r in lr.apply_line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: t.split("\n")[-1] for i, t, _ in rows[:130]}


def test_near_copies_stay(spark):
    def copy(i):
        return "\n".join(" ".join(letters(4, i) if (j, k) == (7, 4) else letters(1, j, k) for k in range(9)) for j in range(16))

    own = [(1000 + i, " ".join(letters(2, i, j) for j in range(40)) + "\nread more here", "a") for i in range(110)]
    rows = [(i, copy(i), "a") for i in range(150)] + own
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in lr.apply_line_rules(df).collect()}
    assert all(kept[i] == t for i, t, _ in rows[:150])
    assert all(kept[i] == t.split("\n")[0] for i, t, _ in own)


def test_long_lines_count(spark):
    passage = " ".join(letters(5, j) for j in range(60))
    rows = [(i, passage + "\n" + " ".join(letters(6, i, j) for j in range(15 if i < 60 else 40)), "a") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {(r.doc_id, r.lost_words, r.kept) for r in lr.line_rules(df).collect()} == {(i, 60, i >= 60) for i in range(120)}
    assert {r.doc_id: r.text for r in lr.apply_line_rules(df).collect()} == {i: t.split("\n")[1] for i, t, _ in rows[60:]}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert lr.line_rules(df).collect() == [] and lr.apply_line_rules(df).collect() == []
