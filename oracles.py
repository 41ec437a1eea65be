"""DuckDB oracles for the registered queries (see ``logweave/catalog.py``).

Each oracle is written independently in DuckDB SQL over the same parquet
views. RE2 (DuckDB's regex engine) has no look-around and ASCII-only ``\\b``
and ``\\w``, so patterns are restated with Unicode classes; a word boundary
becomes a captured neighbour character that is put back, and such layers run
twice so that two matches sharing one neighbour are both found.
"""

from __future__ import annotations

import hashlib

from logweave import config as C

# ── derived tables (same rows as logweave.sources.derived) ─────────────────
LOGS = """
select event_id, ts,
  concat('src', cast(user_id % 4 as varchar)) as source,
  strftime(ts, '%Y-%m-%d %H:%M:%S') as time,
  case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' when 'view' then 'DEBUG' else 'INFO' end as level,
  concat('com.shop.', event_type) as service,
  concat(event_type, ' user ', cast(user_id as varchar), ' duration=', cast(cast(floor(value) as bigint) as varchar), 'ms status ',
         case event_type when 'error' then '500' when 'signup' then '404' else '200' end,
         ' trace ', cast(1700000000000 + event_id % 3000 as varchar)) as msg
from events
"""

RAW = f"""
select event_id, source, case event_id % 8
    when 0 then time || ' [' || level || '] [' || service || '] - ' || msg
    when 1 then time || '  ' || level || ' 123 --- [main] ' || service || ' : ' || msg
    when 2 then strftime(ts, '%H:%M:%S') || '.000 [main] ' || level || '  ' || service || ' - ' || msg
    when 3 then '[' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /item/' || split_part(service, '.', 3) || ' HTTP/1.1" 200'
    when 4 then strftime(ts, '%b %d %H:%M:%S') || ' host1 ' || service || '[123]: ' || msg
    when 5 then '{{"@timestamp":"' || time || '","severity":"' || lower(level) || '","app":"' || service || '","message":"' || msg || '"}}'
    when 6 then level || ' ' || msg
    else 'note: ' || msg end as line
from ({LOGS})
"""

PII = """
select event_id, case event_id % 3
    when 0 then concat_ws(' ', tel, mail, id, card, ip, org, emp, json, b64)
    when 1 then concat_ws('; ', json, ip, tel, org, card, mail, emp, id, b64)
    else concat_ws('，', b64, emp, card, id, tel, mail, json, ip, org) end as text
from (select event_id, 'tel 138' || n as tel, 'mail u' || n || '@mail.example' as mail, 'id 1101011990' || n as id,
    'card 41111111' || n as card, 'ip 10.0.' || cast(event_id % 256 as varchar) || '.7' as ip, 'org 91110108MA' || n as org,
    'emp EMP' || substr(n, 3) as emp,
    '{"name":"' || (['Alice', '王芳', 'Bob Lee', '欧阳娜娜', '张三'])[event_id % 5 + 1] || '"}' as json,
    'b64 ' || repeat('QUJD', cast(20 + event_id % 3 as integer)) || ' end' as b64
  from (select event_id, cast(10000000 + event_id as varchar) as n from events))
"""

TIMED = "(select *, strptime(time, '%Y-%m-%d %H:%M:%S') as t from logs)"

# ── RE2 restatements of the Java (?U) classes ──────────────────────────────
W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"  # word characters
D = r"\p{Nd}"  # digits
S = r"\s\p{Z}"  # white space
NW = f"[^{W}]"
PRE = f"(^|{NW})"
POST = f"({NW}|$)"

# (pattern, match group, groups before it, groups after it, needs two passes)
LAYERS = {
    C.PHONE: (f"(^|[^{D}])((?:\\+?86[-{S}]?)?1[3-9][{D}]{{9}})([^{D}]|$)", 2, [1], [3], True),
    C.EMAIL: (f"([{W}.+\\-]+@[{W}\\-]+\\.[a-zA-Z]{{2,}})", 1, [], [], False),
    C.IP: (f"{PRE}((?:(?:25[0-5]|2[0-4][{D}]|[01]?[{D}][{D}]?)\\.){{3}}(?:25[0-5]|2[0-4][{D}]|[01]?[{D}][{D}]?)){POST}", 2, [1], [3], True),
    C.CARD: (f"{PRE}((?:[{D}][ \\-]?){{14,15}}[{D}](?:[ \\-](?:[{W}])|{NW}|$))", 2, [1], [], True),
    C.CN_ID: (f"{PRE}([{D}]{{17}}[{D}Xx]){POST}", 2, [1], [3], True),
    C.ORG_CODE: (f"{PRE}([0-9A-HJ-NP-RT-Y]{{2}}[{D}]{{6}}[0-9A-HJ-NP-RT-Y]{{9}}[0-9A-HJ-NP-RT-YXx]){POST}", 2, [1], [3], True),
}
JSON_KEYS = "|".join(C.JSON_NAME_KEYS)
JSON_NAME = (f'("(?:{JSON_KEYS})"[{S}]*:[{S}]*")([\\x{{4e00}}-\\x{{9fa5}}a-zA-Z][\\x{{4e00}}-\\x{{9fa5}}a-zA-Z{S}]{{0,9}})(")', 2, [1], [3], False)
BASE64 = ("([A-Za-z0-9+/]{80,}={0,2})", 1, [], [], False)
EMP = (f"(EMP[{D}]{{6}})", 1, [], [], False)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hmac_hex(v: str, key: str) -> str:
    k = key.encode()
    if len(k) > 64:
        k = hashlib.sha256(k).digest()
    k = k.ljust(64, b"\x00")
    ipad = bytes(b ^ 0x36 for b in k).hex()
    opad = bytes(b ^ 0x5C for b in k).hex()
    return f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode({v}))))"


def f_literal(label: str):
    return lambda v: f"(case when {v} is not null then {q(label)} end)"


def f_mask(head: int, tail: int, ch: str = "*"):
    def f(v: str) -> str:
        n = f"length({v})"
        h = f"least({head}, {n})"
        t = f"least({tail}, {n} - {h})"
        return (f"(left({v}, {h}) || repeat({q(ch)}, greatest(0, {n} - {h} - {t})) || "
                f"case when {t} > 0 then right({v}, {t}) else '' end)")
    return f


def f_token(prefix: str, key: str):
    return lambda v: f"('[{prefix}_' || left({_hmac_hex(v, key)}, 8) || ']')"


def f_base64(v: str) -> str:
    head, tail = C.BASE64_NOTE.split("{n}")
    return f"(left({v}, {C.BASE64_KEEP}) || {q(head)} || cast(length({v}) as varchar) || {q(tail)})"


def _card_split(v: str) -> tuple[str, str]:
    """The card match group also holds the look-ahead character: split it off."""
    body = f"regexp_extract({v}, '^((?:[{D}][ \\-]?){{14,15}}[{D}][ \\-]?)', 1)"
    return body, f"substr({v}, length({body}) + 1)"


def sub_expr(t: str, layer, fn, card: bool = False) -> str:
    """Match-wise rewrite of text expression ``t``: every match m → pre + fn(m) + post."""
    pat, g, pre, post = layer[0], layer[1], layer[2], layer[3]
    P = q(pat)
    lists = {i: f"regexp_extract_all({t}, {P}, {i})" for i in set([g] + pre + post)}
    def at(i):
        return f"coalesce(({lists[i]})[i], '')"
    if card:
        m = f"({lists[g]})[i]"
        body, rest = _card_split(m)
        middle = f"{fn(body)} || {rest}"
    else:
        middle = fn(f"({lists[g]})[i]")
    pre_s = " || ".join(at(i) for i in pre) or "''"
    post_s = " || ".join(at(i) for i in post) or "''"
    return (f"array_to_string(list_transform(range(1, len(string_split_regex({t}, {P})) + 1), lambda i: "
            f"string_split_regex({t}, {P})[i] || coalesce({pre_s} || {middle} || {post_s}, '')), '')")


def layer_steps(layer, fn, card: bool = False) -> list[str]:
    """SQL expressions over column ``t``, applied one after the other."""
    step = f"case when regexp_matches(t, {q(layer[0])}) then {sub_expr('t', layer, fn, card)} else t end"
    return [step, step] if layer[4] else [step]


def chain(source_sql: str, key: str, steps: list[tuple[str, list[str]]], text: str = "text") -> str:
    """CTE chain: each step rewrites t; a step with a name flags the entity when it matched first."""
    ctes = [f"s0 as (select {key}, {text} as t, [] :: varchar[] as det from ({source_sql}))"]
    n = 0
    for name, exprs in steps:
        for j, e in enumerate(exprs):
            prev = f"s{n}"
            n += 1
            flag = ""
            if name and j == 0:
                flag = f"case when regexp_matches(t, {q(LAYERS_FOR_FLAG[name])}) and not list_contains(det, {q(name)}) then list_append(det, {q(name)}) else det end"
            det = flag or "det"
            ctes.append(f"s{n} as (select {key}, {e} as t, {det} as det from {prev})")
    return "with " + ", ".join(ctes) + f" select {key}, t as clean, array_to_string(det, ', ') as entities from s{n}"


LAYERS_FOR_FLAG = {k: v[0] for k, v in LAYERS.items()}
LAYERS_FOR_FLAG[C.PERSON] = JSON_NAME[0]
LAYERS_FOR_FLAG["员工工号"] = EMP[0]


def _entity_fn(entity: str, mode: str, key: str):
    if mode == "replace":
        return f_literal(C.DEFAULT_LABELS[entity])
    if mode == "redact":
        return f_literal(C.REDACTED_TEXT)
    if mode == "mask":
        h, t = C.DEFAULT_MASK[entity]
        return f_mask(h, t)
    return f_token(C.DEFAULT_PREFIXES[entity], key)


def redact_steps(entities: list[str], mode: str = "replace", key: str = "", b64: bool = True,
                 custom_mode: str | None = None) -> list[tuple[str, list[str]]]:
    steps: list[tuple[str, list[str]]] = []
    if b64:
        steps.append(("", layer_steps(BASE64, f_base64)))
    for e in C.REGEX_ENTITIES:
        if e in entities:
            steps.append((e, layer_steps(LAYERS[e], _entity_fn(e, mode, key), card=(e == C.CARD))))
    if C.PERSON in entities:
        steps.append((C.PERSON, layer_steps(JSON_NAME, _entity_fn(C.PERSON, mode, key))))
    if custom_mode:
        fn = {"replace": f_literal("<工号>"), "mask": f_mask(3, 4), "pseudo": f_token("PII", key)}[custom_mode]
        steps.append(("员工工号", layer_steps(EMP, fn)))
    return steps


KEY = "fixture-key"
DOCS = "select doc_id, source, text from documents"


def _redact_sql(src: str, keycol: str, **kw) -> str:
    return chain(src, keycol, redact_steps(**kw))


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    ALL = list(C.ALL_ENTITIES)
    o["redact_email"] = _redact_sql(DOCS, "doc_id", entities=[C.EMAIL])
    o["redact_ip"] = _redact_sql(DOCS, "doc_id", entities=[C.IP])
    o["redact_card"] = _redact_sql(DOCS, "doc_id", entities=[C.CARD])
    o["redact_all"] = _redact_sql(DOCS, "doc_id", entities=ALL)
    o["redact_mask"] = _redact_sql(DOCS, "doc_id", entities=ALL, mode="mask")
    o["redact_redact"] = _redact_sql(DOCS, "doc_id", entities=ALL, mode="redact")
    o["redact_token"] = _redact_sql(DOCS, "doc_id", entities=ALL, mode="pseudo", key=KEY)
    o["redact_phone"] = _redact_sql(PII, "event_id", entities=[C.PHONE], b64=False)
    o["redact_cn_id"] = _redact_sql(PII, "event_id", entities=[C.CN_ID], b64=False)
    o["redact_org_code"] = _redact_sql(PII, "event_id", entities=[C.ORG_CODE], b64=False)
    o["redact_json_name"] = _redact_sql(PII, "event_id", entities=[C.PERSON], b64=False)
    o["redact_base64"] = _redact_sql(PII, "event_id", entities=[])
    o["redact_custom"] = _redact_sql(PII, "event_id", entities=[], b64=False, custom_mode="replace")
    o["redact_pii_all"] = _redact_sql(PII, "event_id", entities=ALL, custom_mode="replace")
    o["redact_pii_mask"] = _redact_sql(PII, "event_id", entities=ALL, mode="mask", custom_mode="mask")
    o["redact_pii_token"] = _redact_sql(PII, "event_id", entities=ALL, mode="pseudo", key=KEY, custom_mode="pseudo")
    o["redact_custom_many"] = f"""
        select event_id, regexp_replace(text, 'EMP([0-9]{{5}})([0-9])', '<E\\2>') as clean,
          'ends in ' || regexp_extract(text, 'EMP[0-9]{{5}}([0-9])', 1) as entities from ({PII})"""
    o["redact_persons"] = f"""
        with notes as (
          select o_orderkey, concat('order ', cast(o_orderkey as varchar), ' placed by ', c_name, ' status ', o_orderstatus) as text
          from orders join customer on o_custkey = c_custkey),
        names as (select distinct c_name as name from customer),
        found as (
          select o_orderkey, list(distinct tok) as names
          from (select o_orderkey, unnest(string_split(text, ' ')) as tok from notes) x
          join names on tok = name group by o_orderkey)
        select n.o_orderkey,
          case when f.names is null then n.text else
            list_reduce(list_prepend(n.text, list_sort(f.names)), lambda acc, nm: replace(acc, nm, '<姓名>')) end as clean,
          case when f.names is null then '' else 'PERSON' end as entities
        from notes n left join found f using (o_orderkey)"""
    o["redact_custom_named"] = o["redact_custom"]
    o["redact_persons_external"] = """
        select o_orderkey, regexp_replace('order ' || cast(o_orderkey as varchar) || ' placed by ' || c_name || ' status ' || o_orderstatus, '#[0-9]+', '<姓名>', 'g') as clean,
          case when regexp_matches(c_name, '#[0-9]') then 'PERSON' else '' end as entities
        from orders join customer on o_custkey = c_custkey"""
    letters = "translate(cast(o_custkey as varchar), '0123456789', 'abcdefghij')"
    han = "translate(cast(o_custkey as varchar), '0123456789', '零王李张刘陈杨赵黄周')"
    o["redact_persons_long"] = f"""
        with notes as (select o_orderkey, o_custkey, case when o_custkey % 3 = 0 then '欧' || right({han}, 4)
              else 'Nym' || {letters} || (['', ' de Borbon', ' van der Berg', ' Maria de la Cruz'])[o_custkey % 4 + 1] end as name from orders),
        texts as (select o_orderkey, '订单由' || name || '签收，参见 ' || case when o_custkey % 2 = 0 then name else 'no name' end || ', 完' as text from notes),
        spaced as (select o_orderkey, text, ' ' || regexp_replace(text, '[^A-Za-z]+', ' ', 'g') || ' ' as words from texts),
        names as (select distinct name, regexp_matches(name, '^[A-Za-z ]+$') as latin from notes),
        anchored as (select o_orderkey, text, words, case when regexp_matches(words, 'Nym') then regexp_extract(words, 'Nym[a-z]+') else substr(text, 4, 2) end as anchor from spaced),
        found as (select o_orderkey, list(name order by length(name) desc, name) as found from anchored
          join names on anchor = case when latin then regexp_extract(name, 'Nym[a-z]+') else left(name, 2) end
          where case when latin then contains(words, ' ' || name || ' ') else contains(text, name) end group by o_orderkey)
        select t.o_orderkey, case when found is null then text else
            list_reduce(list_prepend(text, found), lambda acc, nm: replace(acc, nm, '<姓名>')) end as clean,
          case when found is null then '' else 'PERSON' end as entities
        from texts t left join found using (o_orderkey)"""
    docs_all = chain(DOCS, "doc_id, source", redact_steps(entities=ALL))
    o["redact_pages"] = _redact_sql("select page_id, html as text from pages", "page_id", entities=ALL)
    o["redacted_flag"] = f"select doc_id, entities <> '' as redacted from ({chain(DOCS, 'doc_id, source', redact_steps(entities=ALL))})"
    o["redaction_stats"] = f"""
        select source, count(*) filter (where length(clean) > 0) as total_lines,
               count(*) filter (where length(clean) > 0 and entities <> '') as redacted_lines
        from ({docs_all}) group by source"""
    o["entity_counts"] = f"""
        select source, entity, count(*) as lines from
          (select source, unnest(string_split(entities, ', ')) as entity from ({docs_all}) where entities <> '')
        group by source, entity"""
    labels = "case entity " + " ".join(f"when {q(k)} then {q(v)}" for k, v in C.ENTITY_DISPLAY.items()) + " else entity end"
    o["source_summary"] = f"""
        with r as ({docs_all}),
        st as (select source, count(*) filter (where length(clean) > 0) as total_lines,
                      count(*) filter (where length(clean) > 0 and entities <> '') as redacted_lines from r group by source),
        e as (select source, doc_id, unnest(string_split(entities, ', ')) as entity,
                     generate_subscripts(string_split(entities, ', '), 1) as pos from r where entities <> ''),
        h as (select source, entity, count(*) as n, min(doc_id * 1000 + pos) as first from e group by source, entity),
        agg as (select source, string_agg({labels} || '×' || cast(n as varchar), '{C.ENTITY_HIT_SEP}' order by first) as entity_hits
                from h group by source)
        select st.source, total_lines, redacted_lines, coalesce(entity_hits, '{C.NO_HITS}') as entity_hits
        from st left join agg using (source)"""
    o["redacted_only"] = f"""
        select d.source, d.text as original_msg, r.clean as msg, r.entities as redacted_entities
        from ({docs_all}) r join documents d using (doc_id) where r.entities <> ''"""
    # ── parsing: expected fields come from the columns the raw lines were built from
    def parse_expected_for(kind_sql: str) -> str:
        return parse_template.replace("KIND", kind_sql)

    parse_template = f"""
        select event_id, KIND as kind,
          case KIND when 2 then strftime(ts, '%H:%M:%S') || '.000'
                            when 3 then strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000'
                            when 4 then strftime(ts, '%b %d %H:%M:%S')
                            when 6 then '1970-01-01 00:00:00' when 7 then '1970-01-01 00:00:00' else time end as time,
          case KIND when 3 then 'UNKNOWN' when 4 then 'UNKNOWN' when 7 then 'UNKNOWN' else level end as level,
          case KIND when 3 then 'unknown' when 6 then 'unknown' when 7 then 'unknown' else service end as service,
          case KIND when 3 then '/item/' || split_part(service, '.', 3) when 7 then 'note: ' || msg else msg end as msg,
          case KIND when 5 then 'json' when 7 then 'fallback' else 'grok' end as parse_method
        from ({LOGS})"""
    parse_expected = parse_expected_for("event_id % 8")
    o["parse_all"] = parse_expected
    for kind, name in enumerate(["standard", "spring_boot", "logback", "access_log", "syslog", "json", "level_msg", "fallback"]):
        o[f"parse_{name}"] = parse_expected_for(f"cast({kind} as bigint)")
    o["parse_json_edge"] = f"""
        with l as ({LOGS}),
        j as (select event_id, event_id % 8 as kind, time, level, service, msg,
          case event_id % 8
            when 0 then '{{"time":"' || time || '","level":"' || level || '","msg":"' || msg || '"}}'
            when 1 then '{{"time":' || cast(event_id as varchar) || ',"msg":"' || msg || '"}}'
            when 2 then '{{"msg":null,"message":"' || msg || '"}}'
            when 3 then '{{"level":null,"severity":"ERROR","msg":"' || msg || '"}}'
            when 4 then '{{"msg":"first","msg":"' || msg || '"}}'
            when 5 then '{{"x":' || cast(event_id as varchar) || '}}'
            when 6 then '{{"service":{{"a":' || cast(event_id as varchar) || '}},"msg":"' || msg || '"}}'
            else '{{"loglevel":"' || lower(level) || '","logger":"' || service || '","log":"' || msg || '"}}' end as line
          from l)
        select event_id, kind,
          case when kind in (0) then time else '1970-01-01 00:00:00' end as time,
          case when kind in (0, 7) then level else 'UNKNOWN' end as level,
          case when kind = 7 then service else 'unknown' end as service,
          case when kind in (1, 2, 5, 6) then line else msg end as msg,
          case when kind in (1, 2, 6) then 'fallback' else 'json' end as parse_method
        from j"""
    o["parse_method_share"] = f"""
        select count(*) as total_lines, count(*) filter (where parse_method = 'fallback') as fallback_lines,
          coalesce(round_even(100.0 * count(*) filter (where parse_method = 'fallback') / count(*), 1), 0.0)::double as fallback_pct
        from ({parse_expected})"""
    lines = "select doc_id, source, regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g') as text from documents"
    clean = chain(lines, "doc_id, source", redact_steps(entities=ALL))
    o["process_all"] = f"""
        select r.doc_id, r.source, '2024-03-01 08:30:00' as time, 'INFO' as level, 'docs' as service, clean as msg,
          l.text as original_msg, entities as redacted_entities, 'grok' as parse_method
        from ({clean}) r join ({lines}) l using (doc_id)"""
    o["run_totals"] = f"""
        select count(*) as total_lines, count(*) filter (where entities <> '') as redacted_lines,
          0::bigint as fallback_lines, 0.0::double as fallback_pct
        from ({clean})"""
    # ── sinks and sources
    o["sink_csv"] = f"""select event_id, source, time, level, service, '  "' || msg || '", x  ' as msg from ({LOGS})"""
    o["sink_json"] = f"select event_id, source, time, level, service, msg from ({LOGS})"
    o["sink_text"] = f"select concat(time, ' [', level, '] [', service, '] [', source, '] - ', msg) as line from ({LOGS})"
    o["read_logs_labelled"] = f"select line, source || ' (label)' as source from ({RAW})"
    o["read_logs_breaks"] = f"""
        select service as line from ({LOGS}) union all
        select case when event_id % 7 = 0 then 'a' || chr(65533) || 'b' else source end as line from ({LOGS})"""
    o["skip_blank"] = f"select msg as line from ({LOGS}) where event_id % 3 <> 0"
    o["export_ordered"] = f"""select row_number() over (order by time, event_id) - 1 as place,
        concat(time, ' [', level, '] [', service, '] [', source, '] - ', msg) as line from ({LOGS})"""
    o["export_totals"] = f"""
        select count(*) as total_lines, count(*) filter (where entities <> '') as redacted_lines,
          0::bigint as fallback_lines, 0.0::double as fallback_pct,
          count(*) filter (where list_contains(string_split(entities, ', '), '{C.PHONE}')) as phone_lines
        from ({clean})"""
    # ── views
    o["filter_level"] = f"select event_id, source, time, level, service, msg from ({LOGS}) where upper(level) = 'ERROR'"
    o["filter_source"] = f"select event_id, source, time, level, msg from ({LOGS}) where source = 'src2'"
    o["search_msg"] = f"select event_id, source, msg from ({LOGS}) where regexp_matches(msg, trim('SIGNUP user 1[0-9] '), 'i')"
    o["search_unicode"] = f"""select event_id, msg from (select event_id, '用户' || msg || '登录' as msg from ({LOGS}))
        where regexp_matches(msg, '用户[{W}]+ user 1[{D}] .*登录', 'i')"""
    o["merged_view"] = f"""select event_id, row_number() over (order by time, event_id) - 1 as place, time, level, service, msg, source
        from ({LOGS})"""
    o["event_time_forms"] = f"""select event_id, time,
          strftime(case event_id % 4 when 0 then date_trunc('second', ts) when 2 then date_trunc('second', ts) else date_trunc('minute', ts) end, '%Y-%m-%d %H:%M:%S') as ts
        from (select event_id, ts, case event_id % 4
            when 0 then strftime(ts, '%Y-%-m-%-d %-H:%M:%S') when 1 then strftime(ts, '%Y-%m-%dT%H%M')
            when 2 then strftime(ts, '%Y/%m/%d %H:%M:%S') else strftime(ts, '%Y-%m-%d %H:%M') end as time from ({LOGS}))"""
    o["export_text_line"] = f"select event_id, concat(time, ' [', level, '] [', service, '] [', source, '] - ', msg) as line from ({LOGS})"
    # ── timeline
    etype = """case when regexp_matches(msg, '\\b4\\d{2}\\b') then 'http_4xx'
                     when regexp_matches(msg, '\\b5\\d{2}\\b') then 'http_5xx'
                     when regexp_matches(msg, '\\b2\\d{2}\\b') then 'http_200'
                     when regexp_matches(msg, 'MQ|消息队列|queue|topic|publish|consume|消费', 'i') then 'mq'
                     when regexp_matches(msg, '认证成功|auth.*success|login.*success|feign', 'i') then 'auth_ok'
                     when upper(level) in ('ERROR', 'FATAL') then 'error'
                     when upper(level) in ('WARN', 'WARNING') then 'warn' else 'info' end"""
    disp = {t.name: t.display for t in C.DEFAULT_EVENT_TYPES}
    disp_case = "case event_type " + " ".join(f"when {q(k)} then {q(v)}" for k, v in disp.items()) + " end"
    classified = f"(select *, {etype} as event_type from {TIMED.replace('from logs', f'from ({LOGS})')} where t is not null)"
    o["classify_event"] = f"select event_id, event_type, {disp_case} as event_display from (select event_id, {etype} as event_type from ({LOGS}))"
    lane = "case when regexp_matches(msg, 'purchase', 'i') then source || ' › checkout' else source || ' › ' || service end"
    o["assign_lane"] = f"select event_id, {lane} as lane from ({LOGS})"
    o["assign_lane_any"] = f"select event_id, 'signup or any' as lane from ({LOGS})"
    o["classify_custom"] = f"""select event_id,
          case when regexp_matches(msg, 'purchase.*status 500|purchase.*duration=9') then 'error' else 'seen' end as event_type,
          case when regexp_matches(msg, 'purchase.*status 500|purchase.*duration=9') then 'Purchase trouble' else 'Seen' end as event_display
        from ({LOGS})"""
    o["timeline_points"] = f"""select event_id, strftime(t, '%Y-%m-%d %H:%M:%S') as ts, {lane} as lane, event_type,
        {disp_case} as event_display, level, msg from {classified}"""
    bucket = "time_bucket(interval '60 minutes', t, timestamp '1970-01-01')"
    o["event_density"] = f"""
        select strftime({bucket}, '%Y-%m-%d %H:%M:%S') as bucket, count(*) as events,
          count(*) filter (where event_type in ('http_4xx', 'http_5xx', 'error')) as errors,
          count(*) filter (where event_type in ('http_4xx', 'http_5xx', 'error')) / count(*) >= 0.4 as hot
        from {classified} group by {bucket}"""
    bad = f"""
        select {bucket} as b, count(*) as total,
          count(*) filter (where event_type in ('http_4xx', 'http_5xx', 'error')) as errors
        from {classified} group by {bucket}
        having count(*) filter (where event_type in ('http_4xx', 'http_5xx', 'error')) / count(*) >= 0.5"""
    o["anomaly_buckets"] = f"select strftime(b, '%Y-%m-%d %H:%M:%S') as bucket, total, errors, round(errors / total, 6) as rate from ({bad})"
    o["anomaly_windows"] = f"""
        with k as (select epoch(b)::bigint // 3600 as k from ({bad})),
        isl as (select k, k - row_number() over (order by k) as island from k),
        g as (select min(k) as k0, max(k) as k1 from isl group by island)
        select strftime(to_timestamp(k0 * 3600) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as start,
               strftime(to_timestamp((k1 + 1) * 3600) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as "end",
               '异常集中 ' || strftime(to_timestamp(k0 * 3600) at time zone 'UTC', '%H:%M') || '–' ||
                 strftime(to_timestamp((k1 + 1) * 3600) at time zone 'UTC', '%H:%M') as label,
               k1 - k0 + 1 as buckets
        from g"""
    o["downsample"] = f"""
        select event_id, strftime(t, '%Y-%m-%d %H:%M:%S') as ts, source from (
          select event_id, t, source, row_number() over (order by t, event_id) - 1 as r
          from {TIMED.replace('from logs', f'from ({LOGS})')} where t is not null)
        where r % 5 = 0"""
    timed_logs = TIMED.replace('from logs', f'from ({LOGS})')
    o["downsample_auto"] = f"""
        select event_id, strftime(t, '%Y-%m-%d %H:%M:%S') as ts, source from (
          select event_id, t, source, row_number() over (order by t, event_id) - 1 as r, greatest(count(*) over () // 3000, 1) as step
          from {timed_logs} where t is not null)
        where r % step = 0"""
    o["event_density_sampled"] = f"""
        select strftime({bucket}, '%Y-%m-%d %H:%M:%S') as bucket, count(*) as events,
          count(*) filter (where event_type in ('http_4xx', 'http_5xx', 'error')) as errors,
          count(*) filter (where event_type in ('http_4xx', 'http_5xx', 'error')) / count(*) >= 0.4 as hot
        from (select *, row_number() over (order by t, event_id) - 1 as r, greatest(count(*) over () // 3000, 1) as step from {classified})
        where r % step = 0 group by {bucket}"""
    o["anomaly_windows_stream"] = o["anomaly_windows"]
    o["lane_axis"] = f"select distinct {lane} as lane from {classified}"
    # ── latency
    lat = f"""
        select event_id, source || ' › ' || split_part(service, '.', 2) || '.' || split_part(service, '.', 3) as service,
          cast(coalesce(nullif(regexp_extract(msg, '耗时[时长为：:{S}]*([{D}]+(?:\\.[{D}]+)?)[{S}]*ms', 1, 'i'), ''),
                        nullif(regexp_extract(msg, '(?:duration|elapsed|took|latency|cost)[=:{S}]+([{D}]+(?:\\.[{D}]+)?)[{S}]*ms', 1, 'i'), ''),
                        nullif(regexp_extract(msg, '(?:^|[^{W}])([{D}]+(?:\\.[{D}]+)?)[{S}]*ms(?:[^{W}]|$)', 1), '')) as double) as latency_ms,
          time, msg, left(msg, 100) as msg_snippet
        from ({LOGS})"""
    o["extract_latency"] = f"select event_id, service, latency_ms, time, msg, msg_snippet from ({lat}) where latency_ms is not null"
    o["latency_points"] = f"""select event_id, strftime(strptime(time, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') as ts, service, latency_ms, msg
        from ({lat}) where latency_ms is not null"""
    o["latency_summary"] = f"""
        select service, count(*) as samples,
          round_even(quantile_cont(latency_ms, 0.5), 1) as p50_ms, round_even(quantile_cont(latency_ms, 0.95), 1) as p95_ms,
          round_even(quantile_cont(latency_ms, 0.99), 1) as p99_ms, round_even(max(latency_ms), 1) as max_ms,
          round_even(avg(latency_ms), 1) as mean_ms
        from ({lat}) where latency_ms is not null group by service"""
    o["latency_by_p95"] = f"""select p95_ms, service, row_number() over (order by p95_ms, service) - 1 as place
        from ({o['latency_summary']})"""
    o["latency_sketches"] = f"""
        select service, count(*) as samples, max(latency_ms) as max_ms, true as p50_ok, true as p95_ok, true as p99_ok
        from ({lat}) where latency_ms is not null and hour(strptime(time, '%Y-%m-%d %H:%M:%S')) < 12 group by service"""
    o["service_axis"] = f"select distinct service from ({lat}) where latency_ms is not null"
    # ── correlation
    rb = f"select source, {bucket} as b, count(*) as events from {TIMED.replace('from logs', f'from ({LOGS})')} where t is not null group by source, {bucket}"
    o["rate_buckets"] = f"select source, strftime(b, '%Y-%m-%d %H:%M:%S') as bucket, events from ({rb})"
    o["rate_correlation"] = f"""
        with c as ({rb}), bs as (select distinct b from c), ss as (select distinct source from c),
        dense as (select ss.source, bs.b, coalesce(c.events, 0)::double as x from ss cross join bs left join c using (source, b))
        select a.source as source_a, b2.source as source_b, round_even(corr(a.x, b2.x), 3) as r
        from dense a join dense b2 on a.b = b2.b group by a.source, b2.source"""
    # exact: whole numbers of 128 bits, divided once
    o["rate_correlation_large"] = f"""
        with c as ({rb}), bs as (select distinct b from c), n as (select count(*)::hugeint as n from bs),
        big as (select 'big_' || source as source, b, (events + 1000000000)::hugeint as x from c union all select 'flat', b, 1000000000::hugeint from bs),
        ss as (select distinct source from big),
        dense as (select ss.source, bs.b, coalesce(big.x, 0::hugeint) as x from ss cross join bs left join big using (source, b)),
        p as (select a.source as source_a, b2.source as source_b, sum(a.x)::hugeint as sx, sum(b2.x)::hugeint as sy,
            sum(a.x * a.x)::hugeint as sxx, sum(b2.x * b2.x)::hugeint as syy, sum(a.x * b2.x)::hugeint as sxy
          from dense a join dense b2 on a.b = b2.b group by a.source, b2.source)
        select source_a, source_b, case when n * sxx - sx * sx > 0 and n * syy - sy * sy > 0
            then round_even((n * sxy - sx * sy)::double / (sqrt((n * sxx - sx * sx)::double) * sqrt((n * syy - sy * sy)::double)), 3)
            else 'nan'::double end as r
        from p, n"""
    err = f"""select source, epoch(t) as t from {TIMED.replace('from logs', f'from ({LOGS})')}
              where t is not null and (upper(level) in ('ERROR', 'FATAL', 'WARN', 'WARNING') or regexp_matches(msg, '\\b[45]\\d{{2}}\\b'))"""
    casc = f"""
        with e as ({err}), tot as (select source, count(*) as errors_a from e group by source),
        srcs as (select distinct source from e),
        probes as (select e.source as src_a, s.source as src_b, e.t from e join srcs s on s.source <> e.source),
        m as (select p.src_a, p.src_b, p.t, b.t as tb from probes p asof left join e b on p.src_b = b.source and b.t >= p.t),
        hits as (select src_a, src_b, tb - t as lag from m where tb is not null and tb - t <= 600)
        select src_a as source_a, src_b as source_b, count(*) as cascades, any_value(errors_a) as errors_a,
          printf('%.1f%%', count(*) / any_value(errors_a) * 100.0) as trigger_rate,
          round_even(avg(lag), 2) as mean_lag_s, round_even(quantile_cont(lag, 0.5), 2) as median_lag_s,
          round_even(min(lag), 2) as min_lag_s
        from hits join tot on tot.source = hits.src_a group by src_a, src_b having count(*) >= 2"""
    o["error_cascades"] = casc
    o["cascades_by_count"] = f"""select source_a, source_b, row_number() over (order by cascades desc, source_a, source_b) - 1 as place
        from ({casc})"""
    o["cascade_matrix"] = f"""
        with c as ({casc}), s as (select source_a as s from c union select source_b from c)
        select a.s as source_a, b.s as source_b, coalesce(c.cascades, 0)::bigint as cascades
        from s a cross join s b left join c on c.source_a = a.s and c.source_b = b.s"""
    ids = f"""select unnest(regexp_extract_all(msg, '\\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}\\b|\\b\\d{{13,19}}\\b')) as id,
              source, t from {TIMED.replace('from logs', f'from ({LOGS})')} where t is not null"""
    o["shared_ids"] = f"""
        select id, array_to_string(list_sort(list(distinct source)), ', ') as sources, count(distinct source) as n_sources,
          count(*) as n_occurrences, strftime(min(t), '%H:%M:%S') as first_seen, strftime(max(t), '%H:%M:%S') as last_seen,
          round_even(epoch(max(t)) - epoch(min(t)), 1) as span_s
        from ({ids}) group by id having count(distinct source) >= 2"""
    o["shared_ids_top"] = f"""select id, n_sources, n_occurrences, row_number() over (order by n_sources desc, n_occurrences desc, id) as place
        from ({o['shared_ids']}) qualify place <= 300"""
    o["track_id"] = f"""
        select source, strftime(t, '%Y-%m-%d %H:%M:%S') as ts, msg, left(msg, 100) as snippet
        from {TIMED.replace('from logs', f'from ({LOGS})')}
        where t is not null and regexp_matches(msg, '\\b\\d{{13,19}}\\b|\\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}\\b')
          and contains(msg, '1700000000042')"""
    o["shared_ids_custom"] = f"""
        select id, array_to_string(list_sort(list(distinct source)), ', ') as sources, count(distinct source) as n_sources, count(*) as n_occurrences
        from (select unnest(list_concat(regexp_extract_all(msg, '\\b\\d{{13,19}}\\b'), regexp_extract_all(msg, '\\buser \\d{{3,}}\\b'))) as id, source from ({LOGS}))
        group by id having count(distinct source) >= 2"""
    short = "split_part(service, '.', 2) || '.' || split_part(service, '.', 3)"
    lvl = "case when upper(level) in ('INFO', 'DEBUG', 'WARN', 'WARNING', 'ERROR', 'FATAL') then upper(level) else 'OTHER' end"
    flow = f"""
        select 'source_service' as layer, source as src, {short} as dst, count(*) as n from ({LOGS}) group by 1, 2, 3
        union all
        select 'service_level', {short}, {lvl}, count(*) from ({LOGS}) group by 1, 2, 3"""
    o["service_flow"] = flow
    o["flow_nodes"] = f"""
        select 'source' as kind, src as node, sum(n)::bigint as n from ({flow}) where layer = 'source_service' group by src
        union all select 'service', src, sum(n)::bigint from ({flow}) where layer = 'service_level' group by src
        union all select 'level', dst, sum(n)::bigint from ({flow}) where layer = 'service_level' group by dst"""
    return o
