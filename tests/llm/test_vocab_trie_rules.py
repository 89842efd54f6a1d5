"""Conversation trie, spelling variants and weakly supervised quality rules against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cedarlog.llm import conversation_trie, quality_rules, spelling
from tests.llm.conftest import sentence

# ---------------------------------------------------------------- conversation trie

CONV = "conv_id long, turn long, role string, text string, id string, pos int, seq string, shard double"


def _turn_key(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, _turn_key(role or "", text or ""), (role or "", text or "")))
    seqs = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, seq in seqs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        out[c] = seqs.get(base, [])[:h] + seq[h:]
    nodes = defaultdict(list)
    for c, seq in out.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        worth = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += worth
    found = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(out[c]) == len(p))
        found.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(found, key=str)


def run_trie(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", None, "y", 1.0) for r in rows], CONV).repartition(4)
    return sorted([tuple(r) for r in conversation_trie.prefix_trie(df, **kw).collect()], key=str)


def _conversations(seed):
    rng = random.Random(seed)
    stock = [("user" if i % 2 else "assistant", sentence(rng, rng.randint(0, 5))) for i in range(6)]
    rows = []
    for c in [*range(-7, 40), 1_000_000_007]:
        if c % 11 == 3:
            continue  # some families have no first conversation
        for t in range(rng.randint(1, 14)):
            role, text = stock[rng.randrange(3)] if rng.random() < 0.8 else stock[rng.randrange(6)]
            rows.append((c, t, role, text))
    same = [(t, *stock[t % 6]) for t in range(11)]
    rows += [(c, *x) for c in range(100, 140) for x in same]  # copies deeper than a narrow matrix
    rows += [(200, t, "user", f"turn {t}") for t in range(13)]
    rows += [(201, t, "user", f"turn {t}") for t in range(13)]
    rows += [(3, None, None, None), (3, None, None, None), (5, 2, None, "x"), (5, 2, "x", None), (5, 2, "x", None), (8, 1, "ü", "é" * 300)]
    rows += [(None, 0, "user", "nobody's")] * 3
    return rows


@pytest.mark.parametrize("width", [4, 32])
def test_trie_equals_brute_force_at_any_matrix_width(spark, width):
    rows = _conversations(1)
    assert run_trie(spark, rows, width=width) == brute_trie(rows)


def test_trie_over_many_small_ranges(spark, monkeypatch):
    """With tiny ranges most nodes are shared by several tasks."""
    monkeypatch.setattr(conversation_trie, "RANGE_BYTES", 600)
    monkeypatch.setattr(conversation_trie, "PIECE", 2)
    rows = _conversations(2)
    assert run_trie(spark, rows, width=4) == brute_trie(rows)


def test_trie_of_nothing_and_of_no_turns(spark):
    assert run_trie(spark, []) == []
    rows = [(c, 0, "user", "a") for c in (11, 12, 13, 14)]  # no conversation 10 to begin from
    assert run_trie(spark, rows) == brute_trie(rows)


# ---------------------------------------------------------------- spelling variants


def brute_words(rows, min_chars=7, min_count=2):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_variants(words, times=10):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items())


def _typos(rng, word, n):
    letters = "abcdeèüzß"
    for _ in range(n):
        at = rng.randrange(len(word) + 1)
        kind = rng.randrange(3)
        yield word[:at] + (rng.choice(letters) if kind else "") + word[at + (kind != 1) :]


def _documents(seed=3):
    rng = random.Random(seed)
    stems = ["aaaaaaa", "abababab", "mississippi", "überfällig", "straße" * 2, "conversation", "conversion", "Éclairage", "zzzzzzzzzz"]
    rows = []
    for i in range(120):
        words = []
        for s in stems:
            words += [s] * rng.choice([0, 1, 9, 30]) + list(_typos(rng, s, 5))
        for w in list(_typos(rng, rng.choice(stems), 3)):
            words += [w, w, *_typos(rng, w, 2)] if w else []
        words += ["".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(6)]
        rng.shuffle(words)
        rows.append((i, " ".join(words) + "123 x_y_longword×÷"))
    rows += [(None, "withoutid withoutid withoutid"), (7, None), (8, ""), (9, "y" * 5_000 + " " + "y" * 5_000), (9, "y" * 4_999 + " " + "y" * 4_999)]
    return rows + rows[:2]


@pytest.mark.parametrize("shard_words", [10_000, 37])
def test_variants_equal_brute_force_at_any_shard_size(spark, shard_words):
    rows = _documents()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = spelling.variants(df, shard_words=shard_words).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = brute_variants(brute_words(rows))
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    assert sum(w[3] is not None for w in want) > 20 and any(w[5] not in (w[0], w[3]) for w in want if w[3])


def test_index_finds_exactly_the_words_one_edit_away():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abà") for _ in range(rng.randint(3, 8))) for _ in range(400)})
    held = [w.encode("latin-1") for w in words]
    for backwards in (False, True):
        asked = [w[::-1] for w in held] if backwards else held
        index = spelling.Index(asked)
        exact = spelling._exact(spelling.np.array([len(w) for w in words]), backwards)
        who, what = spelling.search(index, asked, exact)
        got = {(words[a], words[b]) for a, b in zip(who, what, strict=True)}
        assert all(one_edit(a, b) for a, b in got)
        half = {(a, b) for a in words for b in words if one_edit(a, b) and (
            b.endswith(a[len(a) // 2 :]) if backwards else b.startswith(a[: len(a) // 2]))}
        assert half <= got


def test_variants_of_nothing(spark, empty):
    assert spelling.variants(empty).collect() == []
    few = spark.createDataFrame([(1, "seldomword"), (2, None)], "doc_id long, text string")
    assert spelling.variants(few).collect() == []


# ---------------------------------------------------------------- quality rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    flat = re.sub(r"[\t\n\x0b\x0c\r]", " ", text) + " "
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_marks": len(re.findall(f"[{quality_rules.MARKS}]", text)), "n_ends": sum(flat.count(m + " ") for m in ".!?"),
        "n_common": sum(w in quality_rules.COMMON for w in words), "n_distinct": len(set(words)),
        "n_digits": sum(c in "0123456789" for c in text), "n_capitals": sum("A" <= c <= "Z" for c in text),
    }


def brute_votes(c):
    def holds(sql):
        return eval(re.sub(r"(?<![<>])=(?!=)", "==", sql).replace("<==", "<=").replace(">==", ">=").replace("AND", "and").replace("OR", "or"), {}, c)  # noqa: S307

    return "".join("-" if holds(r.bad) else "+" if holds(r.good) else "0" for r in quality_rules.RULES)


def brute_em(votes, rounds):
    est = quality_rules.prior()
    n = len(votes)
    for _ in range(rounds):
        p = [brute_posterior(v, est) for v in votes]
        k = quality_rules.PRIOR_SHARE * n

        def share(weights, j, vote, show):
            voted = sum(w for w, v in zip(weights, votes, strict=True) if v[j] != "0")
            right = sum(w for w, v in zip(weights, votes, strict=True) if v[j] == vote)
            return (right + k * show) / (voted + k)

        m = range(len(quality_rules.RULES))
        est = quality_rules.Estimates(
            (sum(p) + k * quality_rules.PRIOR_BALANCE) / (n + k),
            tuple(share(p, j, "+", quality_rules.PRIOR_GOOD) for j in m),
            tuple(share([1 - x for x in p], j, "-", quality_rules.PRIOR_BAD) for j in m),
        )
    return est


def brute_posterior(v, est):
    good, bad = est.balance, 1 - est.balance
    for x, a, b in zip(v, est.on_good, est.on_bad, strict=True):
        good *= {"+": a, "-": 1 - a, "0": 1}[x]
        bad *= {"+": 1 - b, "-": b, "0": 1}[x]
    return good / (good + bad)


def _texts():
    rng = random.Random(12)
    good = [". ".join(sentence(rng, rng.randint(8, 14)) + " the of and is" for _ in range(8)) + "." for _ in range(60)]
    bad = [" ".join(w + rng.choice(["###", "%%", "|"]) for w in sentence(rng, 80).split()) for _ in range(10)]
    bad += ["\n".join(["same line again and again here"] * 20)] * 3
    return good + bad + [
        None, "", " \n\t \x0b", "one two", "a b c", "a b c a b c", "a a a a", "x " * 3_000, "\n".join(["a", "", "a", " a", "b"]),
        "É ü ß — “quoted” 12 34.\r\nNext! Is it? Yes.", "Z" * 30_000, good[0], good[0],
    ]


def test_counts_votes_and_estimates_equal_brute_force(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, 1, "v", "k") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, votes string, kept string")
    got = {r["row"]["doc_id"]: r for r in quality_rules.judge(df.repartition(4), rounds=5).collect()}
    counts = [brute_counts(t) for t in texts]
    for i, c in enumerate(counts):
        assert {k: got[i][k] for k in quality_rules.COUNTS} == c, texts[i]
    votes = [brute_votes(c) for c in counts]
    assert [got[i]["votes"] for i in range(len(texts))] == votes
    est = brute_em(votes, 5)
    for i, c in enumerate(counts):
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        assert got[i]["quality"] == pytest.approx(brute_posterior(votes[i], est), abs=1e-9)
        assert got[i]["base_failed"] == failed
        assert got[i]["kept"] == (not failed and brute_posterior(votes[i], est) >= 0.5)
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in range(60, 78))


def test_quality_rules_filter_and_empty_table(spark, empty):
    assert quality_rules.judge(empty).collect() == []
    assert quality_rules.drop_low_quality(empty).columns == empty.columns
    texts = _texts()[:62]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = quality_rules.drop_low_quality(df)
    assert kept.columns == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == set(range(60))


def test_quality_rules_run_without_python_workers(spark, messy):
    """Native: no Python, pandas or Arrow node in the plans of counts, votes and the result."""
    plan = quality_rules.votes(quality_rules.counts(messy))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
