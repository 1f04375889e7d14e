from spendtrace.llm import preference

TURNS = "pair_id long, turn long, role string, text string, prompt string"


def render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def spans(turns):
    at, out = 0, []
    for r, t in turns:
        begin = at + len(f"<|{r or ''}|>\n")
        at = begin + len(t or "") + len("<|end|>\n")
        if r == "assistant":
            out.append((begin, at - 1))
    return out


def brute(chosen, rejected):
    out = {}
    for p in {r[0] for r in chosen + rejected if r[0] is not None}:
        sides = []
        for rows in (chosen, rejected):
            own = [r for r in rows if r[0] == p]
            own.sort(key=lambda r: tuple((x is not None, x) for x in r[1:4]))
            sides.append([(r[2], r[3]) for r in own])
        n = 0
        while n < min(map(len, sides)) and sides[0][n] == sides[1][n]:
            n += 1
        c, r = sides[0][n:], sides[1][n:]
        out[p] = (n, render(sides[0][:n]), render(c), render(r), spans(c), spans(r))
    return out


def test_prefix_prompts_and_masks(spark):
    long = "wörter 🙂 " * 20_000
    chosen = [
        (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"),
        (2, 0, "user", "q"), (2, 1, "assistant", None), (2, 1, "assistant", None),
        (3, None, None, None), (3, 0, "user", "é🙂"), (3, 1, "assistant", long),
        (4, 0, "user", "only chosen"),
        (6, 0, "user", "same"), (6, 1, "assistant", "same"),
        (7, 0, "user", "a"), (None, 0, "user", "no pair"),
    ]
    rejected = [
        (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (1, 3, "user", "hm"), (1, 4, "assistant", ""),
        (2, 0, "user", "q"), (2, 1, "assistant", ""),
        (3, None, None, None), (3, 0, "user", "é🙂"), (3, 1, "assistant", long + "x"),
        (5, 0, "assistant", "only rejected"),
        (6, 0, "user", "same"), (6, 1, "assistant", "same"),
        (7, 0, "assistant", "a"),
    ]
    frames = [spark.createDataFrame([(*r, "clash") for r in rows], TURNS).repartition(3) for rows in (chosen, rejected)]
    got = {
        r.pair_id: (r.common_turns, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_spans], [tuple(s) for s in r.rejected_spans])
        for r in preference.format_preferences(*frames).collect()
    }
    assert got == brute(chosen, rejected)


def test_no_turns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert preference.format_preferences(empty, empty).collect() == []
    assert preference.format_preferences(*preference.swapped_replies(empty.withColumnRenamed("pair_id", "conv_id"))).collect() == []


def test_swapped_replies_and_native_plan(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c}.{t}") for c in (1, 2, 4, 5) for t in range(2 + c)] + [(3, 0, "user", "x"), (None, 1, "assistant", "y")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = preference.format_preferences(*preference.swapped_replies(talks))
    got = {r.pair_id: r for r in out.collect()}
    assert sorted(got) == [1, 4]
    assert got[1].common_turns == 1 and got[1].chosen == render([("assistant", "1.1")]) and got[1].rejected == render([("assistant", "2.3")])
    assert got[4].common_turns == 5 and got[4].rejected == render([("assistant", "5.5")])
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
