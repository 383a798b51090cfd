"""The same people in DuckDB's SQL: one chain of common table expressions, and a final select for each query."""

from __future__ import annotations

from onefold.model import FIELD_SOURCE_WEIGHT, METHOD_CERTAINTY, PRIORITY, SOURCE_WEIGHT
from onefold.plans.derived import flat_sql

SCALARS = ("full_name", "headline", "years_experience")


def r4(x: str, k: int = 10_000) -> str:
    """Exact rounding at the fourth place (or that of 1 / k), halves to even, of a double that is not negative."""
    high = "(134217729::DOUBLE * v - (134217729::DOUBLE * v - v))"
    q, k = f"(v * {k}::DOUBLE)", f"{k}::DOUBLE"
    over = f"(({q} - floor({q}) - 0.5::DOUBLE) + (({high} * {k} - {q}) + (v - {high}) * {k}))"
    return f"list_transform([({x})::DOUBLE], lambda v: CASE WHEN {over} > 0 THEN floor({q}) + 1 WHEN {over} < 0 THEN floor({q}) WHEN floor({q}) % 2 = 0 THEN floor({q}) ELSE floor({q}) + 1 END / {k})[1]"


def case(column: str, values: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {other} END"


def base(field: str) -> str:
    weight = case("source", SOURCE_WEIGHT, "0.4")
    for (of, source), value in FIELD_SOURCE_WEIGHT.items():
        if of == field:
            weight = f"CASE WHEN source = '{source}' THEN {value} ELSE {weight} END"
    return r4(f"({weight})::DOUBLE * ({case('method', METHOD_CERTAINTY, '0.6')})::DOUBLE")


def adjusted(b: str, agree: str, conflict: str = "FALSE") -> str:
    score = f"({b} + 0.07::DOUBLE * greatest(0, {agree} - 1))"
    return r4(f"greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN {conflict} THEN {score} * 0.85::DOUBLE ELSE {score} END))")


def date(x: str) -> str:
    s = f"lower(trim({x}))"
    months = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1))
    ym = f"regexp_extract({s}, '^([0-9]{{4}})-([0-9]{{1,2}})$', 1) || '-' || lpad(regexp_extract({s}, '^([0-9]{{4}})-([0-9]{{1,2}})$', 2), 2, '0')"
    my = f"regexp_extract({s}, '^([0-9]{{1,2}})/([0-9]{{4}})$', 2) || '-' || lpad(regexp_extract({s}, '^([0-9]{{1,2}})/([0-9]{{4}})$', 1), 2, '0')"
    named = f"regexp_extract({s}, '^([a-z]+) ([0-9]{{4}})$', 2) || '-' || lpad(CAST(CASE regexp_extract({s}, '^([a-z]+) ([0-9]{{4}})$', 1) {months} END AS VARCHAR), 2, '0')"
    return f"CASE WHEN regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{1,2}}$') THEN {ym} WHEN regexp_matches({s}, '^[0-9]{{1,2}}/[0-9]{{4}}$') THEN {my} WHEN regexp_matches({s}, '^[a-z]+ [0-9]{{4}}$') THEN {named} WHEN regexp_matches({s}, '^[0-9]{{4}}$') THEN {s} END"


def email(x: str) -> str:
    return f"CASE WHEN regexp_matches(lower(trim({x})), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN lower(trim({x})) END"


def phone(x: str) -> str:
    d = f"regexp_replace(trim({x}), '[\\s().\\-/]', '', 'g')"
    plan = "1{}[2-9][0-8][0-9][2-9][0-9]{{6}}"
    fine = f"substr(right({d}, 10), 5, 2) <> '11'"
    return f"CASE WHEN trim({x}) LIKE '+%' THEN CASE WHEN regexp_matches({d}, '^\\+{plan.format('')}$') AND {fine} THEN {d} END WHEN regexp_matches({d}, '^{plan.format('?')}$') AND {fine} THEN '+1' || right({d}, 10) END"


HANDLE = "nullif(ltrim(regexp_replace(regexp_replace(trim(github), '/+$', ''), '^.*github\\.com/', ''), '@'), '')"
COUNTRY = "CASE lower(trim(country)) WHEN 'usa' THEN 'US' WHEN 'uk' THEN 'GB' WHEN 'deutschland' THEN 'DE' WHEN 'india' THEN 'IN' END"
SKILL = "CASE lower(s) WHEN 'golang' THEN 'Go' WHEN 'postgres' THEN 'PostgreSQL' WHEN 'python' THEN 'Python' WHEN 'py' THEN 'Python' WHEN 'reactjs' THEN 'React' WHEN 'k8s' THEN 'Kubernetes' WHEN 'machine learning' THEN 'Machine Learning' WHEN 'terraform' THEN 'Terraform' ELSE s END"


def _scalar(f: str) -> list[tuple[str, str]]:
    conflict = "count(DISTINCT value) > 1"
    return [
        (f"o_{f}", f"SELECT cluster_id, ord, source, method, {f} AS value, prio, {base(f)} AS base, row_number() OVER (PARTITION BY cluster_id ORDER BY {base(f)} DESC, prio, ord) AS rn FROM c WHERE {f} IS NOT NULL"),
        (f"w_{f}", f"SELECT cluster_id, value, source, method, base FROM o_{f} WHERE rn = 1"),
        (f"r_{f}", f"SELECT o.cluster_id, any_value(w.value) AS value, any_value(w.base) AS base, any_value(w.source) AS source, count(DISTINCT o.value) AS n_distinct, count(*) FILTER (o.value = w.value) AS n_agree, {conflict.replace('value', 'o.value')} AS conflict FROM o_{f} o JOIN w_{f} w ON o.cluster_id = w.cluster_id GROUP BY o.cluster_id"),
        (f"s_{f}", f"SELECT cluster_id, value, n_distinct, n_agree, conflict, {adjusted('base', 'n_agree', 'conflict')} AS confidence FROM r_{f}"),
    ]


def _list(f: str, one: str) -> list[tuple[str, str]]:
    return [
        (f"v_{f}", f"SELECT cluster_id, {one} AS value, min(ord) AS o1, count(DISTINCT source) AS n FROM c WHERE {one} IS NOT NULL GROUP BY cluster_id, {one}"),
        (f"b_{f}", f"SELECT cluster_id, max({base(f)}) AS base FROM c WHERE {one} IS NOT NULL GROUP BY cluster_id"),
        (f"s_{f}", f"SELECT v.cluster_id, string_agg(value, ',' ORDER BY o1) AS vals, min_by(value, o1) AS first, max(n) AS n, count(*) AS n_values, {adjusted('any_value(base)', 'max(n)')} AS confidence FROM v_{f} v JOIN b_{f} b ON v.cluster_id = b.cluster_id GROUP BY v.cluster_id"),
    ]


def _entries(f: str, columns: dict[str, str], key: tuple[str, ...], some: str) -> list[tuple[str, str]]:
    given = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    keys = ", ".join(f"lower(coalesce({k}, ''))" for k in key)
    return [
        (f"e_{f}", f"SELECT *, row_number() OVER (PARTITION BY cluster_id, {keys} ORDER BY prio, ord) AS rn FROM (SELECT cluster_id, ord, prio, source, method, {given} FROM c) WHERE {some}"),
        (f"l_{f}", f"SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY prio, ord) - 1 AS pos FROM e_{f} WHERE rn = 1"),
    ]


PLACE = {"city": "nullif(trim(city), '')", "region": "nullif(trim(region), '')", "country": COUNTRY}

CHAIN: list[tuple[str, str]] = [
    ("src", flat_sql()),
    ("n", f"""SELECT ord, source, method, {case("source", {s: i for i, s in enumerate(PRIORITY)}, "6")} AS prio, nullif(trim(full_name), '') AS full_name, nullif(trim(headline), '') AS headline, years AS years_experience,
        email AS raw_email, phone AS raw_phone, {email("email")} AS email, {phone("phone")} AS phone, {HANDLE} AS handle, nullif(github, '') AS github, city, region, country, skills, company, title, job_start, job_end, institution, degree, field, end_year FROM src"""),
    ("keys", "SELECT ord, 'email' AS key_type, email AS key_value FROM n WHERE email IS NOT NULL UNION SELECT ord, 'phone', phone FROM n WHERE phone IS NOT NULL UNION SELECT ord, 'github', lower(handle) FROM n WHERE handle IS NOT NULL UNION SELECT ord, 'name', lower(full_name) FROM n WHERE full_name IS NOT NULL"),
    ("have", "SELECT ord, bool_or(key_type <> 'name') AS strong, max(key_value) FILTER (key_type = 'name') AS name FROM keys GROUP BY ord"),
    ("named", "SELECT name, min(ord) AS a, min_by(strong, ord) AS strong FROM have WHERE name IS NOT NULL GROUP BY name"),
    ("edge", "SELECT f.a, k.ord AS b FROM keys k JOIN (SELECT key_type, key_value, min(ord) AS a FROM keys WHERE key_type <> 'name' GROUP BY ALL) f ON k.key_type = f.key_type AND k.key_value = f.key_value WHERE f.a < k.ord UNION SELECT d.a, h.ord FROM have h JOIN named d ON h.name = d.name WHERE NOT h.strong AND NOT d.strong AND d.a < h.ord"),
    ("near", "SELECT a, b FROM edge UNION SELECT b, a FROM edge"),
    ("reach(x, y)", "SELECT ord, ord FROM n UNION SELECT r.x, b.b FROM reach r JOIN near b ON r.y = b.a"),
    ("cl", "SELECT x AS ord, min(y) AS cluster_id FROM reach GROUP BY x"),
    ("c", "SELECT n.*, cluster_id FROM n JOIN cl ON n.ord = cl.ord"),
    ("ids", "SELECT cluster_id, coalesce(min(email), replace(lower(min_by(full_name, ord) FILTER (full_name IS NOT NULL)), ' ', '-'), 'candidate-' || CAST(row_number() OVER (ORDER BY cluster_id) - 1 AS VARCHAR)) AS candidate_id FROM c GROUP BY cluster_id"),
    *[x for f in SCALARS for x in _scalar(f)],
    *_list("emails", "email"),
    *_list("phones", "phone"),
    ("pl", f"SELECT cluster_id, ord, prio, source, method, {', '.join(f'{sql} AS p_{name}' for name, sql in PLACE.items())} FROM c WHERE city <> ''"),
    ("loc", "SELECT cluster_id, " + ", ".join(f"min_by(p_{x}, prio::BIGINT * 1000000000 + ord) FILTER (p_{x} IS NOT NULL) AS {x}, min(prio::BIGINT * 1000000000 + ord) FILTER (p_{x} IS NOT NULL) AS at_{x}" for x in PLACE) + " FROM pl GROUP BY cluster_id"),
    ("s_location", f"SELECT loc.cluster_id, max({base('location')}) AS confidence FROM loc JOIN pl ON loc.cluster_id = pl.cluster_id AND prio::BIGINT * 1000000000 + ord IN (at_city, at_region, at_country) GROUP BY loc.cluster_id"),
    ("s_links", "SELECT cluster_id, min_by(github, prio::BIGINT * 1000000000 + ord) FILTER (github IS NOT NULL) AS github FROM c GROUP BY cluster_id"),
    ("sk", f"SELECT cluster_id, ord, source, {base('skills')} AS base, {SKILL} AS name FROM (SELECT cluster_id, ord, source, method, trim(unnest(string_split(skills, ','))) AS s FROM c WHERE skills <> '')"),
    ("sks", "SELECT cluster_id, name, source, min(ord) AS o1, max(base) AS base FROM sk GROUP BY ALL"),
    ("skill", f"SELECT cluster_id, name, string_agg(source, ',' ORDER BY o1) AS sources, count(*) AS n, {adjusted('max(base)', 'count(*)')} AS confidence FROM sks GROUP BY cluster_id, name"),
    ("s_skills", "SELECT cluster_id, max(confidence) AS confidence, count(*) AS n FROM skill GROUP BY cluster_id"),
    *_entries("experience", {"company": "nullif(trim(company), '')", "title": "nullif(trim(title), '')", "start_": date("job_start"), "end_": date("job_end")}, ("company", "title"), "company IS NOT NULL OR title IS NOT NULL"),
    *_entries("education", {"institution": "nullif(trim(institution), '')", "degree": "nullif(trim(degree), '')", "field": "nullif(trim(field), '')", "end_year": f"CAST(substr({date('end_year')}, 1, 4) AS INTEGER)"}, ("institution", "degree", "field"), "institution IS NOT NULL OR degree IS NOT NULL"),
    ("p", """SELECT ids.cluster_id, candidate_id, sn.value AS full_name, sh.value AS headline, sy.value AS years_experience, sn.confidence AS c_full_name, sh.confidence AS c_headline, sy.confidence AS c_years_experience, em.vals AS emails, em.first AS email,
        em.confidence AS c_emails, ph.vals AS phones, ph.first AS phone, ph.confidence AS c_phones, loc.city, loc.region, loc.country, sl.confidence AS c_location, li.github, ss.confidence AS c_skills, coalesce(ss.n, 0) AS n_skills,
        (SELECT count(*) FROM l_experience e WHERE e.cluster_id = ids.cluster_id) AS n_jobs, (SELECT count(*) FROM l_education e WHERE e.cluster_id = ids.cluster_id) AS n_studies,
        coalesce(sn.conflict, FALSE) AS conflict_full_name, coalesce(sh.conflict, FALSE) AS conflict_headline, coalesce(sy.conflict, FALSE) AS conflict_years_experience
        FROM ids LEFT JOIN s_full_name sn ON ids.cluster_id = sn.cluster_id LEFT JOIN s_headline sh ON ids.cluster_id = sh.cluster_id LEFT JOIN s_years_experience sy ON ids.cluster_id = sy.cluster_id LEFT JOIN s_emails em ON ids.cluster_id = em.cluster_id
        LEFT JOIN s_phones ph ON ids.cluster_id = ph.cluster_id LEFT JOIN loc ON ids.cluster_id = loc.cluster_id LEFT JOIN s_location sl ON ids.cluster_id = sl.cluster_id LEFT JOIN s_links li ON ids.cluster_id = li.cluster_id LEFT JOIN s_skills ss ON ids.cluster_id = ss.cluster_id"""),
    ("q", f"""SELECT *, CASE WHEN k = 0 THEN 0::DOUBLE ELSE {r4("t / k")} END AS overall_confidence, {r4("h / 9::DOUBLE")} AS completeness FROM (SELECT *, {" + ".join(f"coalesce(c_{x}, 0::DOUBLE)" for x in (*SCALARS, "emails", "phones", "location", "skills"))} AS t,
        {" + ".join(f"(c_{x} IS NOT NULL)::INT" for x in (*SCALARS, "emails", "phones", "location", "skills"))} AS k,
        (full_name IS NOT NULL)::INT + (emails IS NOT NULL)::INT + (phones IS NOT NULL)::INT + (country IS NOT NULL)::INT + (headline IS NOT NULL)::INT + (years_experience IS NOT NULL)::INT + (n_skills > 0)::INT + (n_jobs > 0)::INT + (n_studies > 0)::INT AS h FROM p)"""),
    ("an", """SELECT cluster_id, 0 AS part, 0 AS pos, 'implausible_years_experience' AS type, 'years_experience' AS field, CAST(years_experience AS VARCHAR) || ' years' AS detail FROM q WHERE years_experience < 0 OR years_experience > 60
        UNION ALL SELECT cluster_id, 1, pos * 3, 'future_date', 'experience', 'start=' || start_ FROM l_experience WHERE CAST(substr(start_, 1, 4) AS INT) > 2026 UNION ALL SELECT cluster_id, 1, pos * 3 + 1, 'future_date', 'experience', 'end=' || end_ FROM l_experience WHERE CAST(substr(end_, 1, 4) AS INT) > 2026
        UNION ALL SELECT cluster_id, 1, pos * 3 + 2, 'inverted_date_range', 'experience', start_ || ' > ' || end_ FROM l_experience WHERE length(start_) = 7 AND length(end_) = 7 AND start_ > end_
        UNION ALL SELECT cluster_id, 2, pos, 'future_date', 'education', 'end_year=' || end_year FROM l_education WHERE end_year > 2026
        UNION ALL SELECT q.cluster_id, 3, 0, 'email_name_mismatch', 'emails', email FROM q WHERE email IS NOT NULL AND len(regexp_extract_all(lower(full_name), '[a-z]{3,}')) > 0
          AND NOT EXISTS (SELECT 1 FROM v_emails v, unnest(regexp_extract_all(lower(q.full_name), '[a-z]{3,}')) AS t(tok) WHERE v.cluster_id = q.cluster_id AND contains(split_part(v.value, '@', 1), tok))"""),
    ("na", "SELECT cluster_id, count(*) AS n, string_agg('anomaly: ' || type || ' (' || detail || ')', '; ' ORDER BY part, pos) AS reasons FROM an GROUP BY cluster_id"),
    ("t", """SELECT q.*, coalesce(na.n, 0) AS n_anomalies, array_to_string(list_filter([CASE WHEN emails IS NULL THEN 'no_email' END, CASE WHEN phones IS NULL THEN 'no_phone' END, CASE WHEN n_skills = 0 THEN 'no_skills' END, CASE WHEN completeness < 0.5 THEN 'sparse' END, CASE WHEN na.n > 0 THEN 'anomaly' END], lambda x: x IS NOT NULL), ',') AS flags,
        array_to_string(list_filter([CASE WHEN emails IS NULL THEN 'no email address resolved' END, CASE WHEN overall_confidence < 0.6 THEN 'overall_confidence ' || overall_confidence || ' < 0.6' END, CASE WHEN completeness < 0.5 THEN 'completeness ' || completeness || ' < 0.5' END, na.reasons], lambda x: x IS NOT NULL), '; ') AS reasons FROM q LEFT JOIN na ON q.cluster_id = na.cluster_id"""),
]


def sql(select: str) -> str:
    """`select` over the chain, as far as it is needed."""
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({text})" for name, text in CHAIN) + "\n" + select
