"""Common table expressions of the DuckDB form of the queries.

DuckDB writes lambdas as ``lambda x: ...``, sums integers as HUGEINT (cast to BIGINT) and
divides integers to DOUBLE.
"""

from __future__ import annotations

WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z]+'), lambda x: length(x) > 1)"
CTES = {
    "wl": f"select doc_id, {WORDS.format('text')} as w from documents",
    "tok": "select doc_id, unnest(w) as token, unnest(range(1, len(w) + 1)) as pos from wl",
    "pairs": "select w[i] as name, w[i + 1] as alt_name from (select w, unnest(range(1, len(w))) as i from wl) where w[i] <> w[i + 1]",
    "bw": f"select {WORDS.format('text')} as w from benchmark",
    "bp": "select w[i] as a, w[i + 1] as b from (select w, unnest(range(1, len(w))) as i from bw) where w[i] <> w[i + 1]",
    "bad": "select a as name1, b as name2 from bp union select b, a from bp",
    "counted": "select name, alt_name, count(*) as frequency from pairs group by all",
    "sides": "select name, sum(s) as s, sum(s + t) as total from (select name, frequency as s, 0 as t from counted union all select alt_name, 0, frequency from counted) group by name",
    "stats": """select c.name, c.alt_name, c.frequency, coalesce(r.frequency, 0) as reverse_frequency, cast(n.s as bigint) as sum_name_frequency, cast(n.total as bigint) as total_name_frequency,
        cast(a.total as bigint) as total_alt_name_frequency, c.frequency / n.s as ordered_prob, (c.frequency + coalesce(r.frequency, 0)) / (n.total + a.total - c.frequency - coalesce(r.frequency, 0)) as unordered_prob,
        1 - levenshtein(c.name, c.alt_name) / greatest(length(c.name), length(c.alt_name)) as similarity
        from counted c left join counted r on c.name = r.alt_name and c.alt_name = r.name join sides n on c.name = n.name join sides a on c.alt_name = a.name""",
    "alike": "select * from stats where similarity > 0.4 and frequency > 1",
    "pref": "select name, frequency, row_number() over (order by frequency desc, name) as rank from (select token as name, count(*) as frequency from tok group by token having count(*) > 1)",
    "top300": "select * from pref where rank <= 300",
    "top150": "select * from pref where rank <= 150",
    "attached": "select name as tree_name, alt_name as record_name, frequency from counted",
    "cop": "select p_brand as tree_name, p_type as record_name, count(*) as frequency from lineitem join part on l_partkey = p_partkey group by all",
    "cnt": "select name, sum(f) as c from (select tree_name as name, frequency as f from cop union all select record_name, frequency from cop) group by name",
    "edges": "select e.*, t.c as tc, r.c as rc from cop e join cnt t on e.tree_name = t.name join cnt r on e.record_name = r.name",
    "scored": """select *, greatest((frequency + 20) / (tree_total + 20), (frequency + 20) / (record_total + 20)) * 0.62 + 0.38 as score from
        (select *, sum(frequency) over (partition by tree_name) as tree_total, sum(frequency) over (partition by record_name) as record_total from cop)""",
    "vec": "select vec_id as name, label, list_transform(embedding, lambda x: x::double) as v from embeddings",
    "knn": "select a.name, a.label, b.name as other, b.label as other_label, list_cosine_similarity(a.v, b.v) as score from vec a, vec b where a.name <> b.name",
    "near": "select *, row_number() over (partition by name order by round(score, 9) desc, other) as rank from knn",
    "cells": "select label, unnest(range(1, len(v) + 1)) as i, unnest(v) as x from vec",
    "center": "select label, list(x order by i) as c from (select label, i, avg(x) as x from cells group by label, i) group by label",
    "brandtype": "select distinct p_type as head, p_brand as name from part",
}
NEEDS = {
    "tok": ["wl"], "pairs": ["wl"], "bp": ["bw"], "bad": ["bp"], "counted": ["pairs"], "sides": ["counted"], "stats": ["sides", "counted"], "alike": ["stats"], "pref": ["tok"], "top300": ["pref"], "top150": ["pref"],
    "attached": ["counted"], "cnt": ["cop"], "edges": ["cnt", "cop"], "scored": ["cop"], "knn": ["vec"], "near": ["knn"], "cells": ["vec"], "center": ["cells"],
}


def sql(ctes: str, body: str, **own: str) -> str:
    """``body`` under the named expressions, all they need, and ``own`` ones after them."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in ctes.split():
        add(name)
    parts = [f"{n} as ({CTES[n]})" for n in order] + [f"{n} as ({q})" for n, q in own.items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body


def refined_soundex_sql(column: str) -> str:
    letters = f"regexp_replace(upper({column}), '[^A-Z]', '', 'g')"
    digits = f"string_split(translate({letters}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01360240043788015936020505'), '')"
    return f"{letters}[1] || array_to_string(list_filter({digits}, lambda x, i: i = 1 or x <> ({digits})[i - 1]), '')"


def soundex_sql(column: str) -> str:
    """Four characters: the first letter, then digits; h and w do not part equal digits, vowels do."""
    digits = f"list_filter(string_split(translate(upper({column}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230129022455012623019202'), ''), lambda x: x <> '9')"
    kept = f"list_filter(list_filter({digits}, lambda x, i: i = 1 or x <> ({digits})[i - 1])[2:], lambda x: x <> '0')"
    first_silent = f"(upper({column})[1] in ('H', 'W'))"
    silent = f"list_filter(list_filter({digits}, lambda x, i: i = 1 or x <> ({digits})[i - 1]), lambda x: x <> '0')"
    return f"upper({column})[1] || rpad(substring(array_to_string(case when {first_silent} then {silent} else {kept} end, ''), 1, 3), 3, '0')"


def caverphone_sql(column: str) -> str:
    from ..functions.coders import CAVERPHONE_STEPS

    out = f"regexp_replace(lower({column}), '[^a-z]', '', 'g')"
    for pattern, replacement in CAVERPHONE_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return f"substring({out} || '1111111111', 1, 10)"
