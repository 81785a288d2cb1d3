import math
import re

import pytest
from pyspark.sql import functions as F

from facetlens.functions import text as T
from facetlens.operators import items, tokens as K


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value,want", [(None, ""), ("  A\n", "A"), ("NA", "NA"), ("", "")])
def test_clean_text(spark, value, want):
    assert one(spark, value, T.clean_text) == want


def test_string_rules(spark):
    assert one(spark, "  éa B", T.sentence_case) == "Éa B"
    assert one(spark, "low_SES--Hispanic!", T.norm_text) == "low ses hispanic"
    assert one(spark, "F-Black", T.label_components) == ["f black", "fblack", "f", "black", "female"]
    assert one(spark, "Race_x_SES", T.axis_from_category) == "race_ethnicity"
    assert one(spark, "not json", T.parse_json_list) == []
    assert [one(spark, a, T.alpha_label, "double") for a in (0.5, -3.0, 0.0)] == ["+0.5", "-3", "+0"]
    assert one(spark, "This is is odd", T.has_bad_pattern) and not one(spark, "Thesis is odd", T.has_bad_pattern)
    assert one(spark, "Who was likely the nurse's friend?", T.content_terms) == ["nurse's", "friend"]
    assert one(spark, " ĠHello▁", T.token_norm) == "hello"


@pytest.mark.parametrize("prompt,form,want", [
    ("A Deaf person", "deaf", (2, 6, "exact")),
    ("a low  income worker", "low income", (1, 10, "normalized")),
    # A hyphen stays in the space-free prompt, so the match has no offsets.
    ("a low-income worker", "low income", (None, None, "normalized")),
    ("nothing here", "absent", (None, None, "failed")),
    ("text", "  ", (None, None, "failed")),
])
def test_entity_span(spark, prompt, form, want):
    r = spark.createDataFrame([(prompt, form)], "p string, f string").select(T.entity_span(F.col("p"), F.col("f")).alias("s")).first()["s"]
    assert (r["start"], r["end"], r["status"]) == want


def test_term_spans_match_re(spark):
    text = "Aaaa the. THE theatre (a.b) a.b aXb"
    terms = ["aa", "the", "a.b", " ", "zz", "The"]
    got = K.all_term_spans(spark.createDataFrame([(1, text, terms)], "k long, t string, terms array<string>"), "k", "t", "terms").collect()
    want = {(t, m.start(), m.end()) for t in {x.strip().lower() for x in terms} - {""} for m in re.finditer(re.escape(t), text.lower())}
    assert {(r["term"], r["start_char"], r["end_char"]) for r in got} == want


def test_token_overlap_matches_brute_force(spark):
    toks = [(1, i, 3 * i, 3 * i + 2) for i in range(20)] + [(2, 0, 0, 5), (1, 20, 30, 30)]
    spans = [(1, 0, 1), (1, 5, 6), (1, 6, 9), (1, 7, 30), (1, 59, 60), (3, 0, 9)]
    got = K.token_span_overlap(
        spark.createDataFrame(toks, "k long, token_idx int, token_start_char int, token_end_char int"),
        spark.createDataFrame(spans, "k long, start_char int, end_char int"), "k",
    ).collect()
    assert len(got) == len(toks)
    for r in got:
        want = any(k == r["k"] and r["token_end_char"] > s and r["token_start_char"] < e for k, s, e in spans)
        assert r["in_span"] == want, r


def test_entropy(spark):
    df = spark.createDataFrame([("u", 1.0), ("u", 1.0), ("v", 5.0), ("w", 3.0), ("w", 0.0), ("w", 1.0)], "k string, x double")
    got = {r["k"]: r["h"] for r in K.normalized_entropy(df, ["k"], "x", "h").collect()}
    assert got["u"] == pytest.approx(1) and got["v"] == 0 and got["w"] == pytest.approx(0.811278, abs=1e-6)


def test_answer_roles(spark):
    forms = spark.createDataFrame([("race_black", "black people", "blk;  ", 1), ("race_white", "white people", "", 2)], "entity string, noun_form string, aliases string, pos int")
    aliases = items.alias_table(forms, items.manual_aliases(spark), ["entity", "noun_form"], "pos")
    rows = [
        ("a", ["F-Black", "White", "unknown"], ["x", "y", "Not known"], ["Black"]),
        ("b", ["zzz", "qqq", "blk"], ["z", "q", "The blk"], ["Jewish"]),
        ("c", ["unknown", "unknown", "unknown"], ["u", "u", "u"], []),
    ]
    df = spark.createDataFrame(rows, "item_uid string, answer_labels array<string>, answer_texts array<string>, stereotyped_groups array<string>")
    got = {r["item_uid"]: r for r in items.assign_answer_roles(df, aliases).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["stereotyped_answer_idx"], a["nonstereotyped_answer_idx"], a["unknown_answer_idx"]) == (0, 1, 2)
    assert (a["target_entity"], a["nontarget_entity"]) == ("race_black", "race_white")
    assert (b["stereotyped_answer_idx"], b["nonstereotyped_answer_idx"], b["unknown_answer_idx"]) == (None, 0, None)
    assert (b["target_entity"], b["nontarget_entity"], b["nontarget_label"]) == ("", "", "zzz")
    assert (c["unknown_answer_idx"], c["stereotyped_answer_idx"]) == (0, None)


def test_token_tables_reach_localization(spark, tmp_path):
    from facetlens.operators import tokens as K
    from facetlens.sources import tables as S

    rows = ["layer,feature,prompt_index,token_idx,token,activation,is_special_token,inside_identity_span,final_activation"]
    rows += ["24,7,1,0,<s>,9.0,True,False,", "24,7,1,1,old,0.8,False,True,", "24,7,1,2,man,0.4,False,False,", "24,7,2,1,red,0.5,False,False,0.5"]
    (tmp_path / "t.csv").write_text("\n".join(rows) + "\n")
    cols = ["layer", "feature_id", "prompt_id", "token_idx", "token_str", "token_feature_activation", "is_special_token", "is_identity_span_token", "final_token_feature_activation"]
    t = K.token_input(S.read_token_tables(spark, None, str(tmp_path / "t.csv"), 24, cols))
    r = K.token_localization(t).first()
    assert (r["max_token_activation"], r["span_localization_score"], r["final_token_activation"]) == (0.8, 0.5, 0.25)
    p = {x["prompt_id"]: x for x in K.prompt_activation(t, filled=False).collect()}
    assert p["1"]["final_token_activation"] is None and p["2"]["final_token_activation"] == 0.5


def test_all_term_spans_by_splitting(spark, monkeypatch):
    import random

    from facetlens.operators import tokens

    monkeypatch.setattr(tokens, "AUTOMATON_TERMS", 3)
    monkeypatch.setattr(tokens, "KEPT_CHARS", 40)
    draw = random.Random(3)
    words = ["ab", "a", "aba", "É", "é b", " B ", "", "  ", None, "ba", "x.y", "\\E"]
    rows = [(k, "".join(draw.choice("abÉé xy.\\E") for _ in range(draw.randint(0, 60))) if k % 9 else None, draw.sample(words, draw.randint(0, 8)) if k % 7 else None) for k in range(200)]
    rows.append((200, "ab" * 50_000, ["AB", "ab", "ba"]))
    df = spark.createDataFrame(rows, "k long, p string, t array<string>")
    want = set()
    for k, p, t in rows:
        for term in {x.strip().lower() for x in t or [] if x and x.strip()}:
            at, text = 0, (p or "").lower()
            while (at := text.find(term, at)) >= 0:
                want.add((k, term, at, at + len(term)))
                at += len(term)
    out = tokens.all_term_spans(df.repartition(5), "k", "p", "t")
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = tokens.all_term_spans(df, "k", "p", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_shared_loadings_fall_back_to_other_columns(spark):
    from facetlens.operators import triage

    a = spark.createDataFrame([(1, 5, -4.0), (1, 5, 1.0), (2, None, 2.0)], "layer int, feature_id int, shared_part double")
    got = {(r["layer"], r["feature_id"]): r["shared_pc_loading_score"] for r in triage.shared_loading_score([a]).collect()}
    assert got == {(1, 5): 1.0}
    by_layer = {r["layer"]: r["shared_pc_loading_score"] for r in triage.shared_loading_score([a.drop("feature_id")]).collect()}
    assert by_layer == {1: 0.625, 2: 0.5}
    both = a.withColumn("abs_loading", F.col("layer") * 1.0)
    assert {r["shared_pc_loading_score"] for r in triage.shared_loading_score([both], False).collect()} == {0.5, 1.0}
    assert triage.shared_loading_score([a.select("shared_part")]).count() == 1
    assert triage.shared_loading_score([a.select("layer")]).count() == 0


def test_absent_entropy_columns_count_as_zero(spark):
    from facetlens.operators import triage

    spine = spark.createDataFrame([(1, 5, 0.0)], "layer int, feature_id int, span_localization_score double")
    shared = spark.createDataFrame([], "layer int, feature_id int, shared_pc_loading_score double")
    assert abs(triage.triage_scores(spine, shared).first()["template_artifact_score"] - 0.6) < 1e-12
    full = spine.withColumns({"family_entropy": F.lit(None).cast("double"), "template_entropy": F.lit(0.25)})
    assert abs(triage.triage_scores(full, shared).first()["template_artifact_score"] - (0.2 * 0.75 + 0.1)) < 1e-12


def test_token_offsets_where_the_text_lies(spark):
    from facetlens.plans.views import _text_tokens

    rows = [(1, "ab  c é\nx", "p"), (2, "", "q"), (3, None, "r"), (None, "n m", "s"), (4, "a bc", "t"), (4, "a bc", "t"), (5, "w " * 1500, "u")]
    src = spark.createDataFrame(rows, "k long, text string, c string")
    got = [tuple(r) for r in _text_tokens(src, "k", "text", ["c"]).select("k", "c", "token_idx", "token_str", "token_start_char", "token_end_char").collect()]
    want = []
    for k, text, c in rows:
        if text is not None and k != 4:
            want.append((k, c, 0, "<|begin_of_text|>", 0, 0))
            at = 0
            for i, t in enumerate(text.split(" "), 1):
                want.append((k, c, i, t, at, at + len(t)))
                at += len(t) + 1
    # Texts with one key go on in one another's offsets.
    want += [(4, "t", 0, "<|begin_of_text|>", 0, 0)] * 2
    want += [(4, "t", 1, "a", 0, 1), (4, "t", 1, "a", 2, 3), (4, "t", 2, "bc", 4, 6), (4, "t", 2, "bc", 7, 9)]
    assert sorted(got, key=str) == sorted(want, key=str)
    once = _text_tokens(src.filter("k < 4"), "k", "text", [])
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Window")


def test_prompt_activation_by_brute_force(spark):
    rows = [(24, f, p, i, f"t{i}", float((p * 7 + i * 13 + f) % 11), i in (3, 4), False, 0.5 if p % 2 else None, "a" if i % 2 else "b") for p in range(40) for i in range(60) for f in (1, 2)]
    rows += [(24, 1, None, i, None, None if i else float("nan"), False, False, None, None) for i in range(3)]
    names = "layer int, feature_id int, prompt_id long, token_idx int, token_str string, token_feature_activation double, is_entity_span_token boolean, is_special_token boolean, final_token_feature_activation double, family string"
    tokens = spark.createDataFrame(rows, names).coalesce(1)
    for filled in (True, False):
        got = {(r["feature_id"], r["prompt_id"]): r for r in K.prompt_activation(tokens, ["family"], filled).collect()}
        assert len(got) == 81
        assert math.isnan(got[1, None]["max_token_activation"]) and got[1, None]["token_idx_of_max"] == 0 and got[1, None]["max_span_activation"] == 0.0
        for f in (1, 2):
            for p in range(40):
                own = [r for r in rows if r[1] == f and r[2] == p]
                best = min(own, key=lambda r: (-r[5], r[3]))
                r = got[f, p]
                assert (r["max_token_activation"], r["token_idx_of_max"], r["token_str_of_max"], r["max_inside_span"]) == (best[5], best[3], best[4], best[6])
                assert r["max_span_activation"] == max(x[5] for x in own if x[6]) and r["mean_span_activation"] == sum(x[5] for x in own if x[6]) / 2
                assert r["family"] == "a" and r["final_token_activation"] == (0.5 if p % 2 else 0.0 if filled else None)
    no_final = tokens.drop("final_token_feature_activation").filter("prompt_id IS NOT NULL")
    assert all(r["final_token_activation"] == float((r["prompt_id"] * 7 + 59 * 13 + r["feature_id"]) % 11) for r in K.prompt_activation(no_final, ["family"]).collect())


def test_labels_are_no_state_of_token_rows(spark):
    """A label is compared once a (prompt, label), not once a token; parts of a prompt with labels of their own go together."""
    names = "layer int, feature_id int, prompt_id long, token_idx int, token_str string, token_feature_activation double, is_entity_span_token boolean, is_special_token boolean, family string"
    rows = [(1, 1, 7, 2, "x", 0.5, True, False, "b"), (1, 1, 7, 1, "y", 0.5, False, False, "c"), (1, 1, 7, 3, "z", 0.25, True, False, None), (1, 1, 8, 0, None, None, None, False, None)]
    tokens = spark.createDataFrame(rows, names)
    out = K.prompt_activation(tokens, ["family"])
    got = {r["prompt_id"]: r for r in out.collect()}
    assert len(got) == 2 and got[8]["family"] is None and got[8]["token_idx_of_max"] == 0 and got[8]["mean_span_activation"] == 0.0
    r = got[7]
    assert (r["family"], r["token_idx_of_max"], r["token_str_of_max"], r["max_inside_span"]) == ("b", 1, "y", False)
    assert (r["max_token_activation"], r["final_token_activation"], r["max_span_activation"], r["mean_span_activation"]) == (0.5, 0.25, 0.5, 0.375)
    aggregates = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
    assert len(aggregates) == 2 and "min(family" in aggregates[0] and "min(family" not in aggregates[1]


def test_texts_are_split_once(spark):
    from facetlens.plans.views import _text_tokens

    src = spark.createDataFrame([(1, "a b"), (2, " ")], "k long, text string")
    out = _text_tokens(src, "k", "text", [])
    assert sorted(tuple(r)[:3] for r in out.collect()) == [(1, 0, "<|begin_of_text|>"), (1, 1, "a"), (1, 2, "b"), (2, 0, "<|begin_of_text|>"), (2, 1, ""), (2, 2, "")]
    # Only the texts that share a key are split in the plan; the others come split from the task that sums up their offsets.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1


def test_token_lists_give_what_their_rows_give(spark):
    import random

    from pyspark.sql import types as X

    draw = random.Random(5)
    rows, lists = [], []
    for p in [*range(30), 7, None]:
        features, n = draw.sample(range(5), draw.randint(0, 3)), draw.randint(0, 40)
        words = [draw.choice(["The", "the ", "Ġa", "b", "", None]) for _ in range(n)]
        special, span = ([draw.choice([True, False, False, None]) for _ in range(n)] for _ in range(2))
        acts = [[draw.choice([0.0, 0.25, 0.5, None] + [float("nan")] * (p == 3)) for _ in range(n)] for _ in features]
        finals = [draw.choice([0.5, 0.75, None]) for _ in features]
        lists.append((p % 2 if p else 1, features, p, list(range(n)), words, special, span, [a for x in acts for a in x], finals, draw.choice(["u", "v", None])))
        rows += [(p % 2 if p else 1, f, p, i, words[i], special[i], span[i], acts[j][i], finals[j], lists[-1][-1]) for j, f in enumerate(features) for i in range(n)]
    kinds = dict(layer="int", feature_id="int", prompt_id="long", token_idx="int", token_str="string", is_special_token="boolean", is_entity_span_token="boolean")
    kinds |= dict(token_feature_activation="double", final_token_feature_activation="double", family="string")
    of_lists = {c: t if c in ("layer", "prompt_id", "family") else f"array<{t}>" for c, t in kinds.items()}
    by_row, by_list = (spark.createDataFrame(r, X.DataType.fromDDL(", ".join(f"{c} {t}" for c, t in k.items()))) for r, k in ((rows, kinds), (lists, of_lists)))
    plain = lambda df: sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.select(*sorted(df.columns)).collect())
    # A text given twice has two tokens of each place; which of two equal ones is named is open.
    named = ("token_str_of_max", "max_inside_span")
    for drop in ((), (K.FINAL,)):
        a, b = by_row.drop(*drop), by_list.drop(*drop)
        for filled in (True, False):
            once = F.coalesce(F.col("prompt_id") != 7, F.lit(True))
            assert plain(K.prompt_activation(a.filter(once), ["family"], filled)) == plain(K.prompt_activation(b.filter(once), ["family"], filled))
        assert plain(K.prompt_activation(a, ["family"]).drop(*named, K.FINAL.replace("_feature", ""))) == plain(K.prompt_activation(b, ["family"]).drop(*named, K.FINAL.replace("_feature", "")))
    for content in (True, False):
        assert plain(K.token_totals(by_row, content)) == plain(K.token_totals(by_list, content))


def test_localization_makes_no_row_of_a_token(spark, tmp_path):
    from facetlens.plans.views import Views

    texts = [(i, " ".join(["the", "A", f"w{i % 7}", "", "é"] * (1 + i % 4))) for i in range(60)] + [(60, None), (61, ""), (5, "once more")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    v = Views(spark, str(tmp_path))
    plain = lambda df: sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.select(*sorted(df.columns)).collect())
    assert plain(K.token_localization(v.token_lists)) == plain(K.token_localization(v.tokens))
    assert plain(K.prompt_activation(v.token_lists).filter("prompt_id <> 5")) == plain(K.prompt_activation(v.tokens).filter("prompt_id <> 5"))
    # Tokens are exploded for the texts that share a key only, not for the others.
    for table in (K.prompt_activation(v.token_lists), K.token_totals(v.token_lists, content=True)):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode(_starts" not in plan and "explode([3,17,40]" not in plan and "MapInArrow" in plan


def test_token_ranks_by_brute_force(spark, monkeypatch):
    import random

    from pyspark.sql import types as X

    monkeypatch.setattr(K, "ROWS_AT_ONCE", 50)
    monkeypatch.setattr(K, "ROWS_GIVEN", 7)
    draw = random.Random(8)
    rows, lists, want = [], [], []
    for p in [*range(40), None]:
        features, n = draw.sample([*range(5), None], draw.randint(0, 3)), draw.randint(0, 30)
        idx = draw.sample(range(-5, 60), n)
        ends = [draw.choice([0, 2, 2, None]) for _ in idx]
        acts = [[draw.choice([0.0, -0.0, -1.5, 0.5, 2.0, None, float("nan")]) for _ in idx] for _ in features]
        lists.append((24, features, p, idx, ["x"] * n, [0] * n, ends, [a for x in acts for a in x], f"l{p}"))
        for f, act in zip(features, acts):
            order = sorted(range(n), key=lambda i: (act[i] is None, -math.inf if act[i] != act[i] else -(act[i] or 0.0), idx[i]))
            content = [i for i in order if ends[i]]
            for i in range(n):
                rank = content.index(i) + 1 if i in content else -1
                rows.append((24, f, p, idx[i], "x", 0, ends[i], act[i], f"l{p}"))
                want.append((24, f, p, idx[i], f"l{p}", rank, order.index(i) + 1, rank == 1))
    kinds = dict(layer="int", feature_id="int", prompt_id="long", token_idx="int", token_str="string", token_start_char="int", token_end_char="int", token_feature_activation="double", family="string")
    of_lists = {c: t if c in ("layer", "prompt_id", "family") else f"array<{t}>" for c, t in kinds.items()}
    by_row, by_list = (spark.createDataFrame(r, X.DataType.fromDDL(", ".join(f"{c} {t}" for c, t in k.items()))) for r, k in ((rows, kinds), (lists, of_lists)))
    made = K.TokenLists(by_list.filter("prompt_id % 4 > 0"), lambda batches: batches, by_list.schema, by_list.filter("prompt_id % 4 = 0 OR prompt_id IS NULL"))
    kept = ["layer", "feature_id", "prompt_id", "token_idx", "family"]
    for table in (by_row, by_list, made):
        got = K.token_ranks(table, kept)
        assert got.columns == [*kept, *K.RANKS]
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
        whole = K.token_ranks(table)
        assert whole.columns == [*kinds, *K.RANKS] and sorted(str(tuple(r)) for r in whole.select(*got.columns).collect()) == sorted(map(str, want))
        assert sorted(str(tuple(r)) for r in whole.select(*kinds).collect()) == sorted(map(str, rows))


def test_ranks_shuffle_no_token(spark, tmp_path):
    from facetlens.plans import token_queries
    from facetlens.plans.views import Views

    texts = [(i, " ".join(["the", "A", f"w{i % 7}", "", "é"] * (1 + i % 4))) for i in range(60)] + [(60, None), (61, ""), (None, "no key"), (5, "the A w5")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    v = Views(spark, str(tmp_path))
    out = token_queries.token_ranks(v)
    by_row = K.token_ranks(v.tokens, ["layer", "feature_id", "prompt_id", "token_idx"])
    plain = lambda df: sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    assert out.dtypes == by_row.dtypes and plain(out.filter("prompt_id <> 5 OR prompt_id IS NULL")) == plain(by_row.filter("prompt_id <> 5 OR prompt_id IS NULL"))
    assert out.filter("prompt_id = 5").count() == by_row.filter("prompt_id = 5").count() == 45
    # Rows of tokens are dealt and sorted once, and only those of texts that share a key; all others are ranked where the text lies.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(_starts" not in plan and "MapInArrow" in plan and plan.count("row_number()") == 1
    assert by_row._jdf.queryExecution().optimizedPlan().toString().count("row_number()") == 1
