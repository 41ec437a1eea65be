"""Redaction cases of the reference's own tests, run as Spark rows, plus twins."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from logweave import config as C
from logweave.functions.text import hmac_sha256_hex
from logweave.operators import redact


def _cfg(overrides=None, custom=None, secret="test-secret"):
    return C.RedactionConfig(secret, C.built_in_rules() | (overrides or {}), custom or [])


def run(spark, texts, cfg):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = redact.redact(df, "text", cfg).orderBy("i").collect()
    return [(r["text"], list(r["detected"])) for r in rows]


def one(spark, text, cfg):
    return run(spark, [text], cfg)[0]


def test_phone_replace(spark):
    out, det = one(spark, "联系 13812345678 了解详情", _cfg({C.PHONE: C.Replace("<手机>")}))
    assert out == "联系 <手机> 了解详情" and det == [C.PHONE]


def test_email_ip_id_replace(spark):
    assert "<邮箱>" in one(spark, "发送至 alice@example.com", _cfg())[0]
    out, det = one(spark, "证件: 110101199003077814", _cfg())
    assert "110101199003077814" not in out and C.CN_ID in det
    assert "<IP>" in one(spark, "来源 IP: 192.168.1.100", _cfg())[0]


def test_mask_modes(spark):
    cfg = _cfg({C.PHONE: C.Mask(3, 4)})
    assert one(spark, "手机 13812345678", cfg)[0] == "手机 138****5678"
    cfg = _cfg({C.CN_ID: C.Mask(6, 4)})
    # the slice arithmetic keeps 6 + 4 characters of the 18
    assert one(spark, "身份证: 110101199003077814", cfg)[0] == "身份证: 110101********7814"
    cfg = _cfg({C.CARD: C.Mask(0, 4)})
    out = one(spark, "卡号 4111111111111111", cfg)[0]
    assert out.endswith("1111") and "4111111111111111" not in out


def test_token_consistent_and_keyed(spark):
    cfg = _cfg({C.PHONE: C.Token("TEL")})
    (a, _), (b, _) = run(spark, ["电话 13812345678", "再次联系 13812345678"], cfg)
    ta, tb = a.split(" ")[-1], b.split(" ")[-1]
    assert ta == tb and ta.startswith("[TEL_")
    (c, _), (d, _) = run(spark, ["13800000001", "13800000002"], cfg)
    assert c != d
    k2 = _cfg({C.PHONE: C.Token("TEL")}, secret="other")
    assert one(spark, "13812345678", cfg)[0] != one(spark, "13812345678", k2)[0]


def test_token_equals_python_hmac(spark):
    key = "fixed-key"
    vals = ["13812345678", "a", "中文名字", "x" * 200]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(hmac_sha256_hex(F.col("v"), key)).collect()]
    want = [hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest() for v in vals]
    assert got == want
    long_key = "k" * 100
    got = df.select(hmac_sha256_hex(F.col("v"), long_key)).first()[0]
    assert got == hmac.new(long_key.encode(), vals[0].encode(), hashlib.sha256).hexdigest()


def test_redact_mode_and_disabled(spark):
    cfg = _cfg({C.EMAIL: C.Remove()})
    assert "[REDACTED]" in one(spark, "邮件 bob@test.com 已发送", cfg)[0]
    cfg = _cfg()
    del cfg.rules[C.EMAIL]
    assert one(spark, "邮件 keep@example.com 原样保留", cfg) == ("邮件 keep@example.com 原样保留", [])


def test_custom_entities(spark):
    ce = C.Pattern("员工工号", r"EMP\d{6}", C.Replace("<工号>"))
    out, det = one(spark, "操作员 EMP001234 执行了删除", _cfg(custom=[ce]))
    assert out == "操作员 <工号> 执行了删除" and det == ["员工工号"]
    ce = C.Pattern("order", r"ORD-\d{8}", C.Token())
    (a, _), (b, _) = run(spark, ["订单 ORD-20240101", "退款 ORD-20240101"], _cfg(custom=[ce]))
    assert a.split(" ")[-1] == b.split(" ")[-1] and a.split(" ")[-1].startswith("[PII_")
    bad = C.Pattern("bad", "[invalid(")
    assert one(spark, "some text", _cfg(custom=[bad])) == ("some text", [])


def test_stats_clean_and_empty(spark):
    df = spark.createDataFrame(
        [("a", "联系 13900001234"), ("a", "系统正常启动"), ("a", "邮件 bob@test.com 已发送"), ("a", "")], "source string, msg string"
    )
    out = redact.redact(df, "msg", _cfg())
    st = redact.redaction_stats(out, "source").first()
    assert (st["total_lines"], st["redacted_lines"]) == (3, 2)
    counts = {r["entity"]: r["lines"] for r in redact.entity_counts(out, "source").collect()}
    assert counts == {C.PHONE: 1, C.EMAIL: 1}
    assert one(spark, "系统启动完成，所有服务运行正常", _cfg()) == ("系统启动完成，所有服务运行正常", [])
    assert one(spark, "", _cfg()) == ("", [])


def test_layer_order_effects(spark):
    assert one(spark, "13812345678@qq.com", _cfg())[0] == "<手机>@qq.com"
    cfg = _cfg({C.PHONE: C.Mask(3, 4)})
    out, det = one(spark, "13812345678@qq.com", cfg)
    assert det == [C.PHONE, C.EMAIL]
    assert one(spark, "a@mail.example.com", _cfg())[0] == "<邮箱>.com"
    assert one(spark, "4111 1111 1111 1111 foo", _cfg())[0] == "<卡号>foo"


def test_base64_and_json_name(spark):
    blob = "QUJD" * 25
    out, det = one(spark, f"payload {blob} end", _cfg())
    assert out == f"payload {blob[:20]}...[base64 已截断, 原长 100 字节] end" and det == []
    out, det = one(spark, '{"name":"张三","userName":"Bob Smith","x":"y"}', _cfg())
    assert out == '{"name":"<姓名>","userName":"<姓名>","x":"y"}' and det == [C.PERSON]
    cfg = _cfg({C.PERSON: C.Mask(1, 0)})
    assert one(spark, '{"姓名": "张三丰"}', cfg)[0] == '{"姓名": "张**"}'


def test_persons_from_name_table(spark):
    from logweave.operators.persons import person_names

    texts = spark.createDataFrame([(1, "Alice met Bob Smith."), (2, "nobody here"), (3, "Bob Smith, again Bob")], "k int, text string")
    names = spark.createDataFrame([("Bob Smith",), ("Alice",), ("Carol",)], "name string")
    found = person_names(texts, names, ["k"])
    out = redact.redact(found, "text", _cfg(), persons_col="persons").orderBy("k").collect()
    assert [r["text"] for r in out] == ["<姓名> met <姓名>.", "nobody here", "<姓名>, again Bob"]
    assert [list(r["detected"]) for r in out] == [[C.PERSON], [], [C.PERSON]]


def test_pseudo_needs_key(spark):
    with pytest.raises(ValueError):
        run(spark, ["13812345678"], C.RedactionConfig(None, C.built_in_rules(C.Token, [C.PHONE])))


def test_persons_in_unspaced_cjk_text(spark):
    from logweave.operators.persons import person_names

    texts = spark.createDataFrame([(1, "操作员张三执行了删除，李四丰确认"), (2, "张三"), (3, "系统正常")], "k int, text string")
    names = spark.createDataFrame([("张三",), ("李四丰",), ("王五",)], "name string")
    found = {r["k"]: list(r["persons"]) for r in person_names(texts, names, ["k"]).collect()}
    assert found == {1: ["张三", "李四丰"], 2: ["张三"], 3: []}
    out = redact.redact(person_names(texts, names, ["k"]), "text", _cfg(), persons_col="persons").orderBy("k").collect()
    assert out[0]["text"] == "操作员<姓名>执行了删除，<姓名>确认" and list(out[0]["detected"]) == [C.PERSON]


def test_named_groups_are_redacted_and_java_only_rejects_raise(spark):
    df = spark.createDataFrame([("badge EMP123456 twice EMP123456EMP123456",)], "text string")
    cfg = _cfg()
    cfg.patterns = [C.Pattern("badge", r"(?P<the_id>EMP\d{6})(?P=the_id)?")]
    row = redact.redact(df, "text", cfg).first()
    assert row["text"] == "badge <badge> twice <badge>" and list(row["detected"]) == ["badge"]
    cfg.patterns = [C.Pattern("bad", r"(?(1)a|b)(x)?(?(1)y|z)")]
    with pytest.raises(ValueError):
        redact.redact(df, "text", cfg)


def test_names_of_any_length_are_found_after_the_json_layer(spark):
    texts = spark.createDataFrame(
        [(1, "由Juan Carlos de Borbon签收, 欧阳修文远在场"), (2, '{"name":"Ann Lee"} met Ann Lee'), (3, "Juan Carlos only"), (4, None)],
        "k int, text string",
    )
    names = spark.createDataFrame([("Juan Carlos de Borbon",), ("欧阳修文远",), ("Ann Lee",), ("欧",), (" ",)], "name string")
    cfg = C.RedactionConfig(rules=C.built_in_rules(C.Replace, [C.PERSON]))
    got = {r["k"]: (r["text"], list(r["detected"])) for r in redact.redact_names(texts, names, ["k"], "text", cfg).collect()}
    label = cfg.rules[C.PERSON].label
    assert got[1] == (f"由{label}签收, {label}在场", [C.PERSON])
    assert got[2][0] == f'{{"name":"{label}"}} met {label}' and got[3] == ("Juan Carlos only", []) and got[4] == (None, [])


@pytest.mark.parametrize("value,head,tail,want", [("13812345678", 3, 4, "138****5678"), ("abc", 3, 4, "abc"), ("abcdefg", 3, 4, "abcdefg"), ("abcdefgh", 3, 4, "abc*efgh"), ("", 1, 1, ""), ("abcd", 0, 0, "****")])
def test_masks(spark, value, head, tail, want):
    from logweave.functions.text import mask_value

    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(mask_value(F.col("v"), head, tail).alias("m")).first()["m"] == want


def test_needed_literals():
    from logweave.functions.text import needed_literal

    cases = {
        r"EMP\d{6}": "EMP", r"ORD-\d{8}": "ORD-", r"(?:tok|key)=\w+": None, r"\bticket #(\d+)\b": "ticket #", r"a?bc+d": "bc", r"x|yy": None,
        r"(?i)secret": None, r"(ab){2}cd": "ab", r"(?=zz)ab": "ab", r"(abc)?de": "de", r"[ax]bc": "bc", r"\d+": None, r"^id: .*end$": "id: ", "": None,
    }
    assert {p: needed_literal(p) for p in cases} == cases


def test_many_patterns_equal_one_after_the_other(spark):
    """Patterns with a literal run in one loop, others as layers; order, modes and cascades as written."""
    import re

    patterns = [
        C.Pattern("a", r"EMP\d{3}", C.Replace("<ORD-77>")), C.Pattern("b", r"ORD-\d{2}", C.Mask(1, 1)), C.Pattern("c", r"\d{5}"),
        C.Pattern("d", r"tick\w+", C.Remove()), C.Pattern("e", r"k\$\\x", C.Replace("$1 \\")),
        *[C.Pattern(f"p{i}", rf"P{i:03d}x+") for i in range(60)],
    ]
    texts = ["EMP123 ORD-99 55555 ticket", "k$\\x P007xx P059xxx", "none of it", "", None, "marker \ue000 EMP123 \ue000 P001x", "EMP12"]
    mask = lambda v: v[0] + "*" * (len(v) - 2) + v[-1]
    want = []
    for t in texts:
        found = []
        for p in patterns if t is not None else []:
            kind = p.rule
            t, n = re.subn(p.regex, lambda m: kind.label if isinstance(kind, C.Replace) else mask(m[0]) if isinstance(kind, C.Mask) else "[REDACTED]", t)
            found += [p.name] if n else []
        want.append((t, found))
    assert run(spark, texts, C.RedactionConfig(None, {}, patterns)) == want
    assert want[0] == ("<O****7> O****9 <c> [REDACTED]", ["a", "b", "c", "d"])


def test_texts_with_the_marker_take_the_other_path(spark):
    text = 'x \ue000 {"name":"张三"} tel 13812345678 a@b.com 10.0.0.1'
    for kind in (C.Replace, C.Mask, C.Token, C.Remove):
        cfg = C.RedactionConfig("k", C.built_in_rules(kind), [C.Pattern("tel", r"tel")])
        (marked, d1), (plain, d2) = run(spark, [text, text.replace("\ue000", "#")], cfg)
        assert marked.replace("\ue000", "#") == plain and d1 == d2 and len(d1) == 5


def _names_case(spark):
    texts = spark.range(300).select(
        F.when(F.col("id") % 50 < 49, F.col("id") % 290).alias("k"),
        F.concat(F.lit("one two three four Nym"), (F.col("id") % 7).cast("string"), F.lit(" van der Berg, five six seven 操作员张三执行了删除 eight nine")).alias("text"),
    )
    names = spark.createDataFrame([(f"Nym{i} van der Berg",) for i in range(6)] + [("张三",), ("Nym0",), ("李四丰",), ("Nym6 van",)], "name string")
    return texts, names


def test_person_names_are_not_broadcast_and_other_grams_not_shuffled(spark, monkeypatch):
    from logweave.operators import persons

    texts, names = _names_case(spark)
    sent, among = [], persons.maybe_among

    def counted(df, *rest):
        out = among(df, *rest)
        sent.append((df.count(), out.count()))
        return out

    monkeypatch.setattr(persons, "maybe_among", counted)
    found = persons.person_names(texts, names, ["k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "SortMergeJoin" in line and "salt" in line]
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "salt" in line]
    (offered, left), = sent
    assert left < offered / 10


def test_person_names_with_repeated_and_null_keys(spark):
    from logweave.operators.persons import person_names

    texts, names = _names_case(spark)
    held = [r["name"] for r in names.collect()]
    want: dict = {}
    rows = texts.collect()
    for r in rows:
        want.setdefault(r["k"], set()).update(n for n in held if (n in r["text"] if n == "张三" else f" {n} " in r["text"].replace(",", " ")))
    got = person_names(texts, names, ["k"]).collect()
    assert len(got) == len(rows) and all(list(r["persons"]) == sorted(want[r["k"]]) for r in got)
    assert want[None] and len({r["k"] for r in rows}) < len(rows)
