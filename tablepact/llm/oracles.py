"""The same results in SQL, for the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from tablepact.llm.quality import CUTOFFS, Limits
from tablepact.llm.reputation import TWO_LABEL_SUFFIXES
from tablepact.llm.reputation import Limits as UrlLimits

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def quality_steps(documents: str = "documents") -> str:
    """Common table expressions up to ``judged``: all columns of documents, measures, verdict."""
    limits = Limits()
    risk = limits.risk / len(CUTOFFS)
    values = {
        "symbols_per_word": "coalesce(n_symbols / nullif(n_words, 0), 0)",
        "dup_line_share": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)",
        "chars_per_word": "coalesce(word_chars / nullif(n_words, 0), 0)",
    }
    grid = " union all ".join(
        f"select '{rule}' as rule, {i} as step, {cut}::double as cut"
        for rule, cuts in CUTOFFS.items() for i, cut in enumerate(cuts)
    )
    flat = " union all ".join(f"select r, stratum, good, '{rule}' as rule, {rule} as value from holdout" for rule in CUTOFFS)
    return rf"""
    q_docs as (select row_number() over () as r, * from {documents}),
    q_words as (select r, coalesce(text, '') as t, {WORDS.format("coalesce(text, '')")} as w from q_docs),
    q_windows as (select r, i, w[i:i+4] as g from (select r, w, unnest(range(1, len(w) - 3)) as i from q_words where len(w) >= 5)),
    q_twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from q_windows) where c > 1),
    q_cover as (select r, sum(n)::bigint as n_repeat_words from (
        select r, least(5, coalesce(lead(i) over (partition by r order by i) - i, 5)) as n from q_twice) group by r),
    q_lines as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (
        select r, unnest(string_split(t, chr(10))) as line from q_words)
        where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
    measured as (select q_docs.*, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
        coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
        from q_docs join q_words using (r) left join q_cover using (r) left join q_lines using (r)),
    based as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
        {', '.join(f'{sql} as {rule}' for rule, sql in values.items())} from measured),
    marks as (select doc_id, max(quality) as good from labels where doc_id is not null group by doc_id having max(quality) is not null),
    holdout as (select r, lang as stratum, good, {', '.join(CUTOFFS)} from based join marks using (doc_id) where not base_failed),
    grid as ({grid}),
    sizes as (select stratum, count(*) filter (good > 0) as n from holdout group by stratum),
    counts as (select h.stratum, h.rule, step, cut, count(*) filter (good > 0 and value > cut) as k,
        count(*) filter (good <= 0 and value > cut) as hits from ({flat}) h join grid using (rule) group by all),
    tails as (select c.*, case when k < n * {risk} then list_sum(list_transform(range(0, k + 1), lambda i: exp(
        lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln({1 - risk})))) else 1 end as tail
        from counts c join sizes s on c.stratum is not distinct from s.stratum),
    certified as (select *, max((tail > {limits.error} / ({len(CUTOFFS)} * (select count(*) from sizes)))::int)
        over (partition by stratum, rule order by step) as failed from tails),
    chosen as (select stratum, rule, arg_max(cut, {{'gain': hits - {limits.price} * k, 'cut': cut}}) as cut
        from certified where failed = 0 and hits - {limits.price} * k > 0 group by stratum, rule),
    cuts as (select stratum, {', '.join(f"max(cut) filter (rule = '{rule}') as cut_{rule}" for rule in CUTOFFS)}
        from chosen group by stratum),
    judged as (select based.*, not base_failed and not ({' or '.join(f'coalesce({rule} > cut_{rule}, false)' for rule in CUTOFFS)})
        as kept from based left join cuts on lang is not distinct from cuts.stratum)"""


def quality() -> str:
    return f"""with {quality_steps()}
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from judged"""


# The patterns as RE2 takes them, and each kind's test of a match m.
_DIGITS = "regexp_replace(s.m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: case when (len({_DIGITS}) - i) % 2 = 0
    then {_DIGITS}[i]::int else {_DIGITS}[i]::int * 2 - case when {_DIGITS}[i] >= '5' then 9 else 0 end end)) % 10 = 0"""
_TURNED = "replace(s.m, ' ', '')[5:] || replace(s.m, ' ', '')[1:4]"
_MOD97 = f"""list_reduce(list_prepend(0::hugeint, list_transform(string_split({_TURNED}, ''), lambda c:
    case when c between '0' and '9' then 1000 + ascii(c) - 48 else 2000 + ascii(c) - 55 end::hugeint)),
    lambda a, d: case when d >= 2000 then (a * 100 + d - 2000) % 97 else (a * 10 + d - 1000) % 97 end) = 1"""
_SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0.5, True),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
           "len(list_filter(string_split(s.m, '.'), lambda p: len(ltrim(p, '0')) > 3 or coalesce(try_cast(ltrim(p, '0') as int), 0) > 255)) = 0", 0.5, True),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"len({_DIGITS}) between 13 and 19 and {_LUHN}", 0.9, True),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) between 9 and 15", 0.5, True),
    "ssn": (r"[0-9]+-[0-9]+-[0-9]+",
            "regexp_matches(s.m, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$') and not regexp_matches(s.m, '^(000|666|9)|-00-|-0000$')", 0.5, False),
}


def pii_steps(documents: str = "documents") -> str:
    """Common table expressions up to ``found``: a row per span; ``p_docs`` numbers the rows."""
    from tablepact.llm.pii import IBAN, IBAN_LENGTHS, IBAN_LONGEST, KINDS, NEAR, REPORTED

    context = {k.name: k.context for k in KINDS}
    order = [k.name for k in KINDS]
    parts = []

    def scored(kind: str, spans: str, score: float, base: bool) -> str:
        return rf"""
        select r, {order.index(kind)} as nth, '{kind}' as kind, {str(base).lower()} as base, s.a as a, s.b as b,
            {score} + case when regexp_matches(lower(substr(t, greatest(s.a + 1 - {NEAR}, 1)::bigint, least(s.a, {NEAR})::bigint)), '{context[kind]}')
                or regexp_matches(lower(t[(s.b + 1)::bigint:(s.b + {NEAR})::bigint]), '{context[kind]}') then 0.2 else 0 end as score
        from ({spans})"""

    for kind, (pattern, valid, score, base) in _SQL_KINDS.items():
        parts.append(scored(kind, rf"""select * from (select r, t, unnest(list_transform(range(1, len(found) + 1), lambda i: {{
                'm': found[i],
                'a': coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0),
                'b': coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(found[1:i], lambda g: length(g))), 0)}})) as s
            from (select r, t, regexp_extract_all(t, '{pattern}') as found, string_split_regex(t, '{pattern}') as gaps from p_docs
                where regexp_matches(t, '{pattern}'))) where {valid}""", score, base))
    lengths = ((n, countries.replace(" ", "|")) for n, countries in IBAN_LENGTHS.items())
    own = "|".join(f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + f"(?: ?[A-Z0-9]{{{(n - 4) % 4}}})" * ((n - 4) % 4 > 0) for n, c in lengths)
    confirmed = f"len(replace(s.m, ' ', '')) between 15 and 34 and {_MOD97}"
    spans = rf"""
        select r, t, unnest(list_reduce(list([{{'a': s.a, 'b': s.a + length(s.m)}}] order by s.a), lambda x, y: case when y[1].a >= x[-1].b then x || y else x end)) as s
        from (select r, t, any_value(s order by way) as s from (
            select r, t, way, {{'a': i - 1, 'm': case way when 0 then regexp_extract(tail, '^(?:{own})') else regexp_extract(tail, '^(?:{IBAN})') end}} as s
            from (select r, t, i, substr(t, i, {IBAN_LONGEST}) as tail from (select r, t, unnest(range(1, length(t) + 1)) as i from p_docs
                where regexp_matches(t, '[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}')) where regexp_matches(substr(t, i, 9), '^[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}')), (values (0), (1)) w(way))
            where {confirmed} group by r, t, s.a)
        group by r, t"""
    parts.append(scored("iban", spans, 0.9, False))
    return f"""
    p_docs as (select row_number() over () as r, coalesce(text, '') as t, * from {documents}),
    found as (select *, kind || ':' || a || ':' || b as said from ({' union all '.join(parts)}) where base or score >= {REPORTED})"""


def pii() -> str:
    return f"""with {pii_steps()}
    select doc_id, {', '.join(f"count(said) filter (kind = '{kind}') as n_{kind}" for kind in (*_SQL_KINDS, 'iban'))},
        count(said) filter (score > 0.6) as n_confirmed,
        sha256(coalesce(string_agg(said, ',' order by nth, a) filter (base), '')) as base_sha256,
        coalesce(string_agg(said, ',' order by nth, a), '') as spans
    from p_docs left join found using (r) group by r, doc_id"""


def decontamination_steps(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """Common table expressions up to ``held``: a row per distinct document and item it holds."""
    from tablepact.llm import decontaminate as d

    marks = "".join((d.NUMBER, d.NAME, d.UNIT))
    # RE2 never goes deeper, and has no word for groups that give nothing back.
    numbers, names = (x.replace("++", "+").replace("*+", "*") for x in (d.NUMBERS, d.NAMES))

    def steps(name: str) -> str:
        numbered = f"regexp_replace(t, '{numbers}', ' {d.NUMBER} ', 'g')"
        united = rf"regexp_replace(n, '{d.UNITS}', '\1 {d.UNIT} ', 'g')"
        named = rf"regexp_replace(u, '{names}', '\1 {d.NAME} ', 'g')"
        return rf"""
    {name}_1 as (select k, form, t, count(*) as copies from {name}_0 group by all),
    {name}_2 as (select *, row_number() over () as r, {numbered} as n from {name}_1),
    {name}_3 as (select *, {united} as u from {name}_2),
    {name}_4 as (select *, {WORDS.format(rf"regexp_replace(lower({named}), '[^\p{{L}}\p{{N}}{marks}\x20\x09-\x0D]+', '', 'g')")} as w,
        {WORDS.format(r"regexp_replace(lower(t), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g')")} as plain,
        list_transform(regexp_extract_all(t, '({numbers}|{d.NUMBER})'), lambda v: v) as v0,
        list_transform(regexp_extract_all(n, '{d.UNITS}|({d.UNIT})', 2), lambda v: lower(v)) as v1,
        list_transform(regexp_extract_all(u, '{names}|{d.NAME}'), lambda v: lower(regexp_extract(v, '\p{{Lu}}.*$'))) as v2 from {name}_3),
    {name}_slots as (select distinct k, form, r, slot - case form when {d.INSIDE} then 1 else 0 end as slot, kind, value from (
        {' union all '.join(f'''select k, form, r, a - 1 as slot, {i} as kind, v{i}[row_number() over (partition by r order by a)] as value
        from (select k, form, r, v{i}, unnest(w) as token, generate_subscripts(w, 1) as a from {name}_4) where token = '{m}' '''
        for i, m in enumerate((d.NUMBER, d.UNIT, d.NAME)))}))"""

    def windows(tokens: str) -> str:
        return f"""select k, form, width, item_at, w[item_at + 1:item_at + width] as g from (
            select *, unnest(range(0, len(w) - width + 1)) as item_at from (select *, least({d.WIDTH}, len(w)) as width from ({tokens})))"""

    return rf"""
    dd_0 as (select doc_id as k, {d.ALONE} as form, coalesce(text, '') as t from {documents}),
    bb_0 as (select item_id as k, {d.ALONE} as form, coalesce(text, '') as t from {benchmark} where item_id is not null
        union all select item_id, {d.INSIDE}, 'a ' || coalesce(text, '') from {benchmark} where item_id is not null),{steps('dd')},{steps('bb')},
    bb_typed as (select * from ({windows(f"select k, form, case form when {d.INSIDE} then w[2:] else w end as w from bb_4 where len(w) - case form when {d.INSIDE} then 1 else 0 end >= {d.SHORTEST}")})
        where len(list_filter(g, lambda x: not contains('{marks}', x))) >= {d.LITERAL}),
    bb_plain as ({windows(f"select k, {d.PLAIN} as form, plain as w from bb_4 where form = {d.ALONE} and len(plain) >= 2 and k not in (select k from bb_typed where form = {d.ALONE})")}),
    bb_windows as (select *, count(distinct item_at) over (partition by k, form) as of_item from (select distinct * from (select * from bb_typed union all select * from bb_plain))),
    widths as (select distinct form = {d.PLAIN} as as_is, width from bb_windows),
    dd_windows as (select r, as_is, width, doc_at, w[doc_at + 1:doc_at + width] as g from (
        select r, as_is, width, w, unnest(range(0, len(w) - width + 1)) as doc_at
        from (select r, as_is, width, case when as_is then plain else w end as w from dd_4, widths) where len(w) >= width)),
    hits as (select d.r, b.k, b.form, item_at, doc_at - item_at as shift, b.width, of_item
        from dd_windows d join bb_windows b on d.width = b.width and d.g = b.g and d.as_is = (b.form = {d.PLAIN})),
    asked as (select distinct h.r, h.k, h.form, shift, s.slot + shift as slot, s.kind, s.value
        from hits h join (select distinct k, form, slot, kind, value from bb_slots) s on s.k = h.k and s.form = h.form
        and s.slot between h.item_at and h.item_at + h.width - 1),
    answers as (select a.r, a.k, a.form, shift, a.kind, a.value, count(distinct s.value) as n_values, count(*) as slots,
        count(*) filter (lower(s.value) <> lower(a.value)) as changed
        from asked a join dd_slots s on s.r = a.r and s.slot = a.slot and s.kind = a.kind group by all),
    offsets as (select r, k, form, shift, sum(slots) as slots, sum(changed) as changed,
        count(*) filter (n_values = 1) >= {d.CONSISTENT} * count(*) as consistent from answers group by all),
    allowed as (select * from hits h where not exists (
        select 1 from offsets o where o.r = h.r and o.k = h.k and o.form = h.form and o.shift = h.shift and not consistent)),
    runs as (select *, item_at - dense_rank() over (partition by r, k, form, shift order by item_at) as run from allowed),
    lengths as (select r, k, form, max(item_at) - min(item_at) + max(width) as length from runs group by r, k, form, shift, run),
    covered as (select r, k, form, n_windows, item_windows, n_windows >= {d.COVERED} * item_windows as share
        from (select r, k, form, count(distinct item_at) as n_windows, max(of_item) as item_windows from allowed group by r, k, form)
        join (select r, k, form, max(length) as longest from lengths group by r, k, form) using (r, k, form)
        where n_windows >= {d.COVERED} * item_windows or longest >= {d.RUN}),
    best as (select *, row_number() over (partition by r, k order by not share, form) as place from covered),
    held as (select dd_4.k as doc_id, dd_4.t, c.k as item_id, n_windows, item_windows,
        coalesce((select sum(slots) from offsets o where o.r = c.r and o.k = c.k and o.form = c.form and consistent), 0)::bigint as n_slots,
        coalesce((select sum(changed) from offsets o where o.r = c.r and o.k = c.k and o.form = c.form and consistent), 0)::bigint as n_changed, dd_4.copies
        from best c join dd_4 on dd_4.r = c.r where place = 1)"""


def decontamination() -> str:
    return f"""with {decontamination_steps()}
    select doc_id, item_id, n_windows, item_windows, n_slots, n_changed, copies from held"""


def url_verdicts(rules: Sequence[tuple[str, str]], number: str, pages: str = "pages", labels: str = "labels") -> str:
    """Verdicts by rules, else by the posterior of the host; the beta distribution as a sum of its series."""
    limits = UrlLimits()
    usual, least, most = limits.spread
    listed = ", ".join(f"('{verdict}', '{text.partition('/')[0]}', '/{text.partition('/')[2]}', '{text}')" for verdict, text in rules)
    suffixes = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    dots = {k: f"array_to_string(labels[-{k}:], '.')" for k in (1, 2, 3)}

    known = "(1 / (1 / (s + 1) + 1 / (weight + 1)) - 1)"

    def strength(groups: str) -> str:
        return f"""(select case when sum(n - 1) > 0 then 1 / least({most}, greatest({least},
            (sum(n * (k / n - above) * (k / n - above) / (above * (1 - above))) - count(*)) / sum(n - 1))) - 1
            else 1 / {usual}::double - 1 end as s from {groups} where n > 0)"""

    return rf"""
    with shown as (
        select page_id, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') as h0,
            coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path,
            try_cast(regexp_extract(url, '{number}', 1) as bigint) as doc_id from {pages}),
    bad as (select doc_id, bool_or(coalesce(quality = 0, false) or coalesce(toxic = 1, false)) as bad
        from {labels} where quality is not null or toxic is not null group by doc_id),
    known as (select page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path, bad.bad
        from shown left join bad on shown.doc_id = bad.doc_id),
    hosts as (select host, count(bad)::double as n, (count(*) filter (where bad))::double as k,
        regexp_replace(host, '\.?(:[0-9]*)?$', '') as name from known group by host),
    split as (select *, string_split(name, '.') as labels, regexp_matches(name, '^[0-9.]+$|[\[\]:]') as address from hosts),
    placed as (select *, {dots[2]} in ({suffixes}) as long from split),
    named as (select *, case when address then name when long then {dots[2]} else {dots[1]} end as suffix,
        case when address or len(labels) < 2 then name when long then {dots[3]} else {dots[2]} end as domain from placed),
    overall as (select (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) as above, coalesce(sum(n), 0) + 1 as weight from named),
    suffixes as (select suffix, sum(n) as n, sum(k) as k, any_value(above) as above, any_value(weight) as weight from named, overall group by suffix),
    suffix_means as (select suffix, ({known} * above + k) / ({known} + n) as above, {known} + n as weight from suffixes, {strength("suffixes")}),
    domains as (select suffix, domain, sum(n) as n, sum(k) as k, any_value(above) as above, any_value(weight) as weight
        from named join suffix_means using (suffix) group by suffix, domain),
    domain_means as (select domain, ({known} * above + k) / ({known} + n) as above, {known} + n as weight from domains, {strength("domains")}),
    rated as (select host, n, k, above, weight from named join domain_means using (domain)),
    posterior as (select host, n, k, {known} * above + k as a, {known} * (1 - above) + n - k as b from rated, {strength("rated")}),
    judged as (select host, n, k, a / (a + b) as mean, 1 - list_sum(list_transform(range(20000), lambda i:
        exp((a + i) * ln({limits.most_bad}) + b * ln(1 - {limits.most_bad}) + lgamma(a + b + i) - lgamma(b) - lgamma(a + 1 + i)))) as p_above from posterior),
    rules(verdict, own, start, rule) as (values {listed}),
    fitting as (select host, path, rule, verdict, row_number() over (partition by host, path order by length(rule) desc, length(own) desc, rule) as place
        from (select distinct host, path from known) join rules on (host = own or ends_with(host, '.' || own)) and starts_with(path, start))
    select known.page_id, known.host, known.path, f.rule, coalesce(f.verdict, case when p_above >= {limits.confidence} then 'block' else 'allow' end) as verdict,
        n::bigint as n_labelled, k::bigint as n_bad, round(mean, 6) as mean_bad, round(greatest(p_above, 0), 6) as p_above
    from known join judged on known.host = judged.host
    left join (select * from fitting where place = 1) f on f.host = known.host and f.path = known.path
    """


def spelling(documents: str = "documents") -> str:
    """Near words by what is left of them without one code point, in place of composed machines."""
    return r"""
    with recursive crc_table as (select list(v order by n) as tab from (
        select n, list_reduce([n::ubigint] || range(8)::ubigint[], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end) as v from range(256) r(n))),
    runs as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-zÀ-ÿ]+')) as run from DOCUMENTS),
    long as (select id, run, count(*) as c, hex(encode(id || ':' || run)) as bytes from runs where length(run) >= 7 group by id, run),
    hashed as (select run, c, xor(list_reduce([4294967295::ubigint] || list_transform(range(1, length(bytes), 2), lambda i: ('0x' || substr(bytes, i, 2))::ubigint),
        lambda a, b: xor(a >> 8, tab[((xor(a, b) & 255) + 1)::bigint])), 4294967295::ubigint) as h from long, crc_table),
    altered as (select c, case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word from hashed),
    vocabulary as (select word, sum(c)::bigint as n from altered where length(word) >= 7 group by word having sum(c) >= 2),
    less as (select word, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, unnest(range(0, length(word))) as i from vocabulary)),
    near as (
        select a.word, b.word as other from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
        union select a.word, v.word from less a join vocabulary v on a.rest = v.word
        union select v.word, a.word from less a join vocabulary v on a.rest = v.word),
    best as (select near.word, count(*) as n_near, max(v.n) as most, list(near.other order by v.n desc, near.other)[1] as other
        from near join vocabulary v on v.word = near.other group by near.word),
    formed as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when most >= 10 * v.n then other end as form, case when most >= 10 * v.n then most end as form_n
        from vocabulary v left join best on v.word = best.word),
    followed(word, last, depth) as (select word, word, 0 from formed
        union all select f.word, g.form, depth + 1 from followed f join formed g on g.word = f.last where g.form is not null)
    select word, form, root, n, n_near::bigint as n_near, form_n from formed
    join (select word as w, max_by(last, depth) as root from followed group by word) on w = word
    """.replace("DOCUMENTS", documents)


def filter_audit(documents: str = "documents", labels: str = "labels") -> str:
    """Every order applied to every kind of document, step by step."""
    return rf"""
    with texts as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part, {WORDS.format("coalesce(text, '')")} as w from {documents}),
    judged as (select doc_id, part,
        case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
        || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end
        || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
        || case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end as fails from texts),
    marked as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from {labels} where doc_id is not null group by doc_id),
    counted as (select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
        from judged left join marked on judged.doc_id = marked.doc_id group by part, fails),
    l(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
    orders as (select a.x || b.x || c.x || d.x || e.x as o from l a, l b, l c, l d, l e
        where b.x <> a.x and c.x not in (a.x, b.x) and d.x not in (a.x, b.x, c.x) and e.x not in (a.x, b.x, c.x, d.x)),
    gone as (select part, o, list_min(list_transform(range(1, 6), lambda i: case when contains(fails, substr(o, i, 1)) then i end)) as step, n, good, toxic
        from counted, orders),
    removed as (select part, o, step, sum(n) as n, sum(good) as good, sum(toxic) as toxic from gone where step is not null group by all),
    steps as (select part, o, step, substr(o, step, 1) as x, total from (select part, sum(n) as total from counted group by part), orders, range(1, 6) s(step)),
    fails as (select part, x, coalesce(sum(n) filter (where contains(fails, x)), 0) as failing, coalesce(sum(n) filter (where fails = x), 0) as alone from counted, l group by part, x),
    every as (select s.part, s.o, s.step::int as step, s.x, total, coalesce(n, 0) as n, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
        from steps s left join removed r on r.part = s.part and r.o = s.o and r.step = s.step)
    select e.part, o as filter_order, step, (total - sum(n) over (partition by e.part, o order by step))::bigint as kept, n::bigint as removed,
        (failing - n)::bigint as redundant, alone::bigint as unique_fails, good::bigint as good_lost, toxic::bigint as toxic_lost,
        (sum(n) over (partition by e.part, e.x))::bigint as shapley
    from every e join fails f on f.part = e.part and f.x = e.x
    """
