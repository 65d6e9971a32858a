"""The same results in plain SQL, for checking every query on whole tables."""

from __future__ import annotations

from tablewright.catalog.dirty import ORDER_TEXT_SQL, ORDERS_LATER_SQL, ORDERS_NOW_SQL, PERSONS_SQL

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)"
KINDS = "('name', 'phone', 'email')"
CENTS = "cast(round(l_extendedprice * 100) as bigint)"
UNITS = "cast(l_quantity as bigint)"
ORDER_AMOUNT = "cast(round(o_totalprice * 100) as bigint)"
TOKENS = {
    "clean": "('', 'nan', 'none', 'nat', '<na>')",
    "split": "('', 'nan', 'none', 'nat')",
    "merge": "('', 'nan')",
}
FORMATS = "['%Y-%m-%d', '%Y/%m/%d', '%Y%m%d', '%Y-%m-%d %H:%M:%S', '%Y年%m月%d日', '%m/%d/%Y', '%d/%m/%Y']"


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def blank(x: str, mode: str = "clean") -> str:
    return f"({x} IS NULL)" if mode == "compare" else f"({x} IS NULL OR lower({trim(x)}) IN {TOKENS[mode]})"


def text(x: str) -> str:
    return f"(CASE WHEN {blank(x)} THEN '' ELSE {trim(x)} END)"


def digits(x: str) -> str:
    return f"regexp_replace({text(x)}, '[^0-9]', '', 'g')"


def kind(x: str) -> str:
    return (
        f"(CASE WHEN {blank(x)} THEN 'blank' WHEN length({digits(x)}) >= 10 AND starts_with({digits(x)}, '1') THEN 'phone' "
        f"WHEN contains({x}, '@') AND contains({x}, '.') THEN 'email' "
        f"WHEN regexp_full_match(replace({text(x)}, ' ', ''), '[一-鿿·]{{2,8}}') THEN 'name' ELSE 'unknown' END)"
    )


def day(x: str) -> str:
    return f"cast(try_strptime({text(x)}, {FORMATS}) as date)"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def listed(items: list[str]) -> str:
    return f"array_to_string(list_filter([{', '.join(items)}], lambda i: i IS NOT NULL), ';')"


def phone_ok(x: str) -> str:
    return f"regexp_full_match({digits(x)}, '1[3-9][0-9]{{9}}')"


def email_form(x: str) -> str:
    return f"replace(lower({text(x)}), ' ', '')"


def email_ok(x: str) -> str:
    return f"regexp_full_match({email_form(x)}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')"


def fixed_cell(column: str, candidate: str, ok: str, problem: str) -> str:
    good = f"(NOT {blank(column)} AND coalesce({ok}, false))"
    return (
        f"SELECT _row_id, CASE WHEN {good} AND {candidate} <> {text(column)} THEN {candidate} ELSE {column} END AS value, "
        f"({good} AND {candidate} <> {text(column)}) AS fixed, "
        f"CASE WHEN NOT {blank(column)} AND NOT {good} THEN '{problem}' END AS problem FROM ({PERSONS_SQL}) t"
    )


def shifted(base: str, name: str = "name") -> str:
    """Rows of ``base`` with kinds, problem, fixed and the moved values n2, p2, e2."""

    def moved(slot: str, own: str) -> str:
        k = {"name": "kn", "phone": "kp", "email": "ke"}[slot]
        other = tuple(s for s in ("name", "phone", "email") if s != slot)
        return (
            f"CASE WHEN NOT fixed THEN {own} WHEN kn = '{slot}' THEN {name} WHEN kp = '{slot}' THEN phone "
            f"WHEN ke = '{slot}' THEN email WHEN {k} IN {other} THEN '' ELSE {own} END"
        )

    return f"""
    SELECT *, {moved('name', name)} AS n2, {moved('phone', 'phone')} AS p2, {moved('email', 'email')} AS e2 FROM (
      SELECT *, (misplaced AND problem IS NULL) AS fixed FROM (
        SELECT *, CASE WHEN twice THEN 'shift_ambiguous' WHEN misplaced AND blocked THEN 'shift_unrecognised' END AS problem FROM (
          SELECT *,
            ((kn IN {KINDS} AND kn IN (kp, ke)) OR (kp IN {KINDS} AND kp = ke)) AS twice,
            ((kn IN {KINDS} AND kn <> 'name') OR (kp IN {KINDS} AND kp <> 'phone') OR (ke IN {KINDS} AND ke <> 'email')) AS misplaced,
            ((kn = 'unknown' AND 'name' IN (kp, ke)) OR (kp = 'unknown' AND 'phone' IN (kn, ke))
              OR (ke = 'unknown' AND 'email' IN (kn, kp))) AS blocked
          FROM (SELECT *, {kind(name)} AS kn, {kind('phone')} AS kp, {kind('email')} AS ke FROM ({base}) b) k) s) p) f"""


TRIMMED = f"CASE WHEN {blank('name')} THEN name ELSE {trim('name')} END"
# phone is an identifier column: the jobs read it as text first
PERSONS_TEXT_SQL = (
    f"SELECT _row_id, name, CASE WHEN {blank('phone')} THEN NULL ELSE {trim('phone')} END AS phone, email, last_order, city "
    f"FROM ({PERSONS_SQL}) t"
)


def repaired(base: str = PERSONS_SQL) -> str:
    """Every row with the repaired cells n3, p3, e3, d3, its review reasons and the fixes behind them."""
    step1 = f"SELECT *, {TRIMMED} AS n1, {day('last_order')} AS dd FROM ({base}) t"
    moved = shifted(step1, "n1")
    return f"""
    SELECT *, {listed(['problem', 'pp', 'ep', 'dp', 'mn', 'mp'])} AS reasons,
      (ft::int + fn::int + fp::int + fe::int + pf::int + ef::int + df::int) AS n_fixes
    FROM (
      SELECT *, CASE WHEN {blank('n2')} THEN 'missing_name' END AS mn, CASE WHEN {blank('p3')} THEN 'missing_phone' END AS mp,
        (n2) AS n3, coalesce(n1 <> name, false) AS ft,
        (fixed AND {text('n2')} <> {text('n1')}) AS fn, (fixed AND {text('p2')} <> {text('phone')}) AS fp,
        (fixed AND {text('e2')} <> {text('email')}) AS fe
      FROM (
        SELECT *,
          (problem IS NULL AND {phone_ok('p2')} AND {digits('p2')} <> {text('p2')}) AS pf,
          CASE WHEN problem IS NULL AND {phone_ok('p2')} AND {digits('p2')} <> {text('p2')} THEN {digits('p2')} ELSE p2 END AS p3,
          CASE WHEN problem IS NULL AND NOT {blank('p2')} AND NOT {phone_ok('p2')} THEN 'invalid_phone' END AS pp,
          (problem IS NULL AND {email_ok('e2')} AND {email_form('e2')} <> {text('e2')}) AS ef,
          CASE WHEN problem IS NULL AND {email_ok('e2')} AND {email_form('e2')} <> {text('e2')} THEN {email_form('e2')} ELSE e2 END AS e3,
          CASE WHEN problem IS NULL AND NOT {blank('e2')} AND NOT {email_ok('e2')} THEN 'invalid_email' END AS ep,
          (dd IS NOT NULL AND {iso('dd')} <> {text('last_order')}) AS df,
          coalesce({iso('dd')}, last_order) AS d3,
          CASE WHEN dd IS NULL AND NOT {blank('last_order')} THEN 'bad_date' END AS dp
        FROM ({moved}) m) r) q"""


ALL_BLANK = " AND ".join(blank(c) for c in ("name", "phone", "email", "last_order", "city"))


def cleaned(base: str = PERSONS_SQL) -> str:
    """Repaired rows with their removal reason: blank, full duplicate, then same (name, phone)."""
    return f"""
    SELECT *, CASE WHEN is_blank THEN 'blank_row' WHEN copy > 1 THEN 'full_duplicate'
        WHEN has_key AND same_key > 1 THEN 'key_duplicate' END AS reason
    FROM (
      SELECT *, NOT ({blank('n3')} AND {blank('p3')}) AS has_key,
        row_number() OVER (PARTITION BY is_blank, copy > 1, {text('n3')}, {text('p3')} ORDER BY _row_id) AS same_key
      FROM (
        SELECT *, row_number() OVER (PARTITION BY is_blank, n3, p3, e3, d3, city ORDER BY _row_id) AS copy
        FROM (SELECT *, ({ALL_BLANK}) AS is_blank FROM ({repaired(base)}) a) b) c) d"""


def kept_rows(base: str = PERSONS_SQL) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY _row_id) AS result_row FROM ({cleaned(base)}) x WHERE reason IS NULL"


def fix_entries(source: str) -> str:
    """One row per repair; blank cells show as ''."""

    def shown(x: str) -> str:
        return f"CASE WHEN {blank(x)} THEN '' ELSE {x} END"

    entries = (
        ("ft", "name", "name", "n1", "fix_trim"),
        ("fn", "name", "n1", "n2", "fix_shift"),
        ("fp", "phone", "phone", "p2", "fix_shift"),
        ("fe", "email", "email", "e2", "fix_shift"),
        ("pf", "phone", "p2", "p3", "fix_phone"),
        ("ef", "email", "e2", "e3", "fix_email"),
        ("df", "last_order", "last_order", "d3", "fix_date"),
    )
    return " UNION ALL ".join(
        f"SELECT result_row, '{f}' AS field, {shown(old)} AS old, {shown(new)} AS new, '{r}' AS reason FROM {source} WHERE {flag}"
        for flag, f, old, new, r in entries
    )


QUALITY = f"""
SELECT count(*) AS total, count(*) FILTER (is_blank) AS blank_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT name, phone, email, last_order, city FROM ({PERSONS_SQL}) u) w) AS dup_rows,
  count(*) FILTER (fixed OR problem IS NOT NULL) AS shifted,
  count(*) FILTER ((kp = 'phone' AND NOT {phone_ok('phone')}) OR kp = 'unknown') AS bad_phone,
  count(*) FILTER ((ke = 'email' AND NOT {email_ok('email')}) OR ke = 'unknown') AS bad_email,
  count(*) FILTER (dd IS NULL AND NOT {blank('last_order')}) AS bad_date,
  count(*) FILTER ({blank('name')} OR {blank('phone')}) AS missing_key
FROM ({shifted(f"SELECT *, {day('last_order')} AS dd, ({ALL_BLANK}) AS is_blank FROM ({PERSONS_SQL}) t")}) z
"""


def penalty(measure: str, cap: int, weight: int) -> str:
    return f"least({cap}, round_even({measure}::double / total * {weight}, 0))"


SCORE = "100 - " + " - ".join(
    (
        penalty("blank_rows", 25, 100),
        penalty("dup_rows", 25, 80),
        penalty("shifted", 20, 120),
        penalty("bad_phone", 15, 100),
        penalty("bad_email", 10, 80),
        penalty("bad_date", 10, 80),
        penalty("missing_key", 15, 100),
    )
)
EVENTS = "SELECT event_id, user_id, event_type, cast(ts as date) AS day FROM events"


def one_per_key(order: str) -> str:
    return (
        f"SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {order}) AS n "
        f"FROM ({EVENTS}) e) r WHERE n = 1"
    )


SLICES = {
    "F": "SELECT 0 AS ord, 'orders_F.csv' AS file, o_orderkey AS c0, o_custkey AS c1, {a} AS c2, o_orderpriority AS c3, NULL AS c4, NULL AS c5 FROM orders WHERE o_orderstatus = 'F'",
    "O": "SELECT 1, 'orders_O.csv', o_orderkey, o_custkey, {a}, o_orderpriority, NULL, NULL FROM orders WHERE o_orderstatus = 'O'",
    "P": "SELECT 2, 'orders_P.csv', o_orderkey, NULL, {a}, NULL, o_orderpriority, o_custkey FROM orders WHERE o_orderstatus = 'P'",
}
MERGED = " UNION ALL ".join(s.format(a=ORDER_AMOUNT) for s in SLICES.values())
MERGED_NAMES = ("订单号", "姓名", "销售额", "优先级", "级别", "客户 代码")
HELD = {"F": (0, 1, 2, 3), "O": (0, 1, 2, 3), "P": (0, 2, 4, 5)}
OWN_HEADERS = {
    "F": {0: "订单号", 1: "客户名→姓名", 2: "金额→销售额", 3: "优先级"},
    "O": {0: "订单号", 1: "联系人→姓名", 2: "销售额", 3: "优先级"},
    "P": {0: "订单号", 2: "营收→销售额", 4: "级别", 5: "客户 代码"},
}
STATS = " UNION ALL ".join(
    f"SELECT {i} AS ord, 'orders_{s}.csv' AS file, '{name}' AS \"column\", {p} AS pos, count(*) AS rows, count(c{p}) AS filled, "
    f"count(*) - count(c{p}) AS empty, "
    + (
        f"CASE WHEN count(c{p}) = count(*) THEN 'normal' WHEN count(c{p}) = 0 THEN 'all_empty' ELSE 'partly_empty' END"
        if p in HELD[s]
        else "'absent'"
    )
    + f" AS note FROM ({MERGED}) m WHERE ord = {i}"
    for i, s in enumerate(SLICES)
    for p, name in enumerate(MERGED_NAMES)
)
WARNINGS = f"""
WITH st AS ({STATS}), n AS (SELECT count(DISTINCT ord) AS files FROM st),
c AS (SELECT "column", pos, count(*) FILTER (filled > 0) AS f FROM st GROUP BY "column", pos)
SELECT 'partly_filled' AS kind, st."column" AS "column", NULL AS other_column, string_agg(file, '、' ORDER BY file) AS missing_in
FROM st JOIN c USING ("column", pos), n WHERE c.f > 0 AND c.f < n.files AND st.filled = 0 GROUP BY st."column"
UNION ALL
SELECT 'same_field', a."column", b."column", NULL FROM c a, c b, n WHERE a.pos < b.pos AND a.f > 0 AND b.f > 0 AND a.f + b.f = n.files
  AND NOT EXISTS (SELECT 1 FROM st x JOIN st y ON x.ord = y.ord WHERE x.pos = a.pos AND y.pos = b.pos AND x.filled > 0 AND y.filled > 0)
"""

COMPARED = f"""
SELECT coalesce(a.customer, b.customer) AS customer, coalesce(a.nth, b.nth) AS ord, a.customer AS ca, b.customer AS cb,
  a.status AS sa, b.status AS sb, a.priority AS pa, b.priority AS pb, a._row_id AS ra, b._row_id AS rb,
  CASE WHEN b._row_id IS NULL THEN CASE WHEN coalesce(a.customer, b.customer) IN (SELECT customer FROM ({ORDERS_LATER_SQL}) l) THEN 'only_a_surplus' ELSE 'only_a' END
       WHEN a._row_id IS NULL THEN CASE WHEN coalesce(a.customer, b.customer) IN (SELECT customer FROM ({ORDERS_NOW_SQL}) l) THEN 'only_b_surplus' ELSE 'only_b' END
       WHEN trim(a.status) <> trim(b.status) OR trim(a.priority) <> trim(b.priority) THEN 'changed' ELSE 'same' END AS result,
  CASE WHEN a._row_id IS NOT NULL AND b._row_id IS NOT NULL THEN concat_ws('、',
    CASE WHEN trim(a.priority) <> trim(b.priority) THEN 'priority' END, CASE WHEN trim(a.status) <> trim(b.status) THEN 'status' END) END AS changed_fields
FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY _row_id) AS nth FROM ({ORDERS_NOW_SQL}) x) a
FULL OUTER JOIN (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY _row_id) AS nth FROM ({ORDERS_LATER_SQL}) y) b
  ON a.customer = b.customer AND a.nth = b.nth
"""


def safe(x: str) -> str:
    inner = f"CASE WHEN {blank(x, 'split')} THEN '空值' ELSE {trim(x)} END"
    inner = f"regexp_replace(regexp_replace({inner}, '[\\\\/:*?\"<>|]', '_', 'g'), '\\s+', ' ', 'g')"
    inner = f"substr(trim({inner}, ' .'), 1, 80)"
    return f"CASE WHEN {inner} = '' THEN '空值' ELSE {inner} END"


BRANDS = (
    "SELECT p_partkey AS rid, CASE p_partkey % 4 WHEN 0 THEN replace(p_brand, '#', '/') WHEN 1 THEN replace(p_brand, '#', ':') "
    "WHEN 2 THEN replace(p_brand, '#', '_') ELSE ' none ' END AS brand FROM part"
)
BRAND_PARTS = f"""
SELECT label || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END AS file_label, value, n_rows, first_row,
  CASE WHEN value IS NULL THEN 'blank_key' WHEN nth > 1 THEN 'renamed' ELSE '' END AS note FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY value IS NOT NULL, first_row) AS nth FROM (
    SELECT {safe('value')} AS label, value, count(*) AS n_rows, min(rid) AS first_row
    FROM (SELECT rid, CASE WHEN NOT {blank('brand', 'split')} THEN brand END AS value FROM ({BRANDS}) p) v GROUP BY value) g) h"""
PART_MODELS = (
    "SELECT p_partkey AS rid, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '/') WHEN 1 THEN replace(p_name, ' ', ':') "
    "WHEN 2 THEN replace(p_name, ' ', '_') ELSE ' none ' END AS model FROM part"
)
ROLE_CELLS = (
    ("姓名", "name", "name,sales_person"),
    ("手机号", "phone", "phone,dedupe_key"),
    ("邮箱", "email", "email"),
    ("最近下单", "last_order", "date,latest"),
    ("城市", "city", ""),
)
MONTH_AMOUNTS = f"SELECT {iso('o_orderdate')} AS d, o_orderpriority, o_orderstatus, {ORDER_AMOUNT} AS a FROM orders"


def numbered(columns: str, base: str) -> str:
    return f"SELECT {columns} FROM ({base}) z"


ORACLES: dict[str, str] = {
    "sales_by_person": f"""
        SELECT person, amount, qty, row_number() OVER (ORDER BY amount DESC, person) AS rank FROM (
          SELECT c_name AS person, cast(sum({CENTS}) as bigint) AS amount, cast(sum({UNITS}) as bigint) AS qty
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_name) s""",
    "sales_by_product": f"""
        SELECT p_name AS product, cast(sum({CENTS}) as bigint) AS amount, cast(sum({UNITS}) as bigint) AS qty
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name""",
    "sales_by_month": f"""
        SELECT strftime(l_shipdate, '%Y-%m') AS month, cast(sum({CENTS}) as bigint) AS amount, cast(sum({UNITS}) as bigint) AS qty
        FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1""",
    "sales_by_month_text": f"""
        SELECT strftime(d, '%Y-%m') AS month, cast(sum(_row_id) as bigint) AS amount, count(*) AS qty
        FROM (SELECT _row_id, {day('last_order')} AS d FROM ({PERSONS_SQL}) t) s WHERE d IS NOT NULL GROUP BY 1""",
    "qty_default": f"""
        SELECT person, amount, qty, row_number() OVER (ORDER BY amount DESC, person) AS rank FROM (
          SELECT o_orderpriority AS person, cast(sum({ORDER_AMOUNT}) as bigint) AS amount, count(*) AS qty FROM orders GROUP BY 1) s""",
    "sales_report_job": f"""
        SELECT 'person' AS part, o_orderpriority AS key, cast(sum(a) as bigint) AS amount, 2 * count(*) AS qty FROM ({MONTH_AMOUNTS}) m GROUP BY 2
        UNION ALL SELECT 'product', o_orderstatus, cast(sum(a) as bigint), 2 * count(*) FROM ({MONTH_AMOUNTS}) m GROUP BY 2
        UNION ALL SELECT 'month', substr(d, 1, 7), cast(sum(a) as bigint), 2 * count(*) FROM ({MONTH_AMOUNTS}) m GROUP BY 2""",
    "coerced_amounts": f"""
        SELECT count(*) AS rows, count(*) FILTER (amount IN ('n/a', '1d')) AS coerced_to_zero FROM ({ORDER_TEXT_SQL}) t""",
    "to_number": f"""
        SELECT o_orderkey, coalesce(try_cast({trim("translate(amount, ',￥元', '')")} AS double), 0.0) AS amount FROM ({ORDER_TEXT_SQL}) t""",
    "text_cell": f"""
        SELECT o_orderkey, CASE WHEN {blank('code')} THEN NULL
          WHEN contains(code, 'E+') AND try_cast(code AS double) IS NOT NULL THEN cast(cast(cast(code AS double) AS bigint) AS varchar)
          WHEN regexp_full_match({trim('code')}, '-?[0-9]+\\.0') THEN regexp_replace({trim('code')}, '\\.0$', '') ELSE {trim('code')} END AS code
        FROM ({ORDER_TEXT_SQL}) t""",
    "date_cell": f"""
        SELECT o_orderkey, CASE WHEN shown = '' THEN NULL WHEN shown LIKE '%x' THEN shown
          WHEN shown LIKE '% 0:00:00' THEN split_part(shown, ' ', 1) ELSE replace(shown, '/', '-') END AS shown FROM ({ORDER_TEXT_SQL}) t""",
    "sink_cells_typed": """
        SELECT cast(event_id as bigint) AS event_id, cast(user_id as varchar) AS phone,
          CASE WHEN ts = date_trunc('day', ts) THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts FROM events""",
    "safe_label": f"SELECT o_orderkey, {safe('part')} AS label FROM ({ORDER_TEXT_SQL}) t",
    "key_text": f"SELECT o_orderkey, coalesce({trim('part')}, '') || '||' || coalesce({trim('code')}, '') AS key FROM ({ORDER_TEXT_SQL}) t",
    "dedupe_key": f"""
        SELECT _row_id, CASE WHEN NOT ({blank('name')} AND {blank('phone')}) THEN {text('name')} || '||' || {text('phone')} END AS key
        FROM ({PERSONS_SQL}) t""",
    "blank_modes": "SELECT _row_id, "
    + ", ".join(f"{blank(c, m)} AS {c}_{m}" for c in ("name", "phone", "last_order", "city") for m in ("clean", "split", "merge", "compare"))
    + f" FROM ({PERSONS_SQL}) t",
    "classify_contact": f"SELECT _row_id, {kind('name')} AS name, {kind('phone')} AS phone, {kind('email')} AS email FROM ({PERSONS_SQL}) t",
    "fix_phone": fixed_cell("phone", digits("phone"), phone_ok("phone"), "invalid_phone"),
    "fix_email": fixed_cell("email", email_form("email"), email_ok("email"), "invalid_email"),
    "fix_date": fixed_cell("last_order", iso(day("last_order")), f"{day('last_order')} IS NOT NULL", "bad_date"),
    "month_key": f"SELECT _row_id, strftime({day('last_order')}, '%Y-%m') AS month FROM ({PERSONS_SQL}) t",
    "latest_key": f"""
        SELECT _row_id, CASE WHEN {blank('last_order')} THEN '0' ELSE '1' || coalesce({iso(day('last_order'))}, {trim('last_order')}) END AS recency
        FROM ({PERSONS_SQL}) t""",
    "fix_shifted": f"SELECT _row_id, problem, fixed, n2 AS name, p2 AS phone, e2 AS email FROM ({shifted(PERSONS_SQL)}) s",
    "repair_rows": f"SELECT _row_id, n3 AS name, p3 AS phone, e3 AS email, d3 AS last_order FROM ({repaired()}) r",
    "trim_name": f"SELECT _row_id, {TRIMMED} AS name, coalesce({TRIMMED} <> name, false)::int AS fixes FROM ({PERSONS_SQL}) t",
    "flag_required": f"""
        SELECT _row_id, {listed([f"CASE WHEN {blank('name')} THEN 'missing_name' END", f"CASE WHEN {blank('phone')} THEN 'missing_phone' END"])} AS reasons
        FROM ({PERSONS_SQL}) t""",
    "row_marker": f"""
        SELECT _row_id, concat_ws('；', CASE WHEN n_fixes > 0 THEN 'fixed' END, CASE WHEN reasons <> '' THEN 'to_review' END) AS marker
        FROM ({repaired()}) r""",
    "review_rows": f"SELECT _row_id, reasons FROM ({repaired()}) r WHERE reasons <> ''",
    "fix_log_rows": f"WITH kept AS ({kept_rows()}) {fix_entries('kept')}",
    "quality_counts": QUALITY,
    "health": f"""
        SELECT score, level, 'advice_' || level AS advice FROM (
          SELECT score, CASE WHEN score >= 85 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS level FROM (
            SELECT cast(greatest(0, least(100, {SCORE})) as int) AS score FROM ({QUALITY}) q) s) l""",
    "column_roles": " UNION ALL ".join(
        f"SELECT '{header}' AS \"column\", {i}::int AS position, '{role}' AS role, "
        + ", ".join(f"count(*) FILTER ({kind(c)} = '{k}') AS {k}_cells" for k in ("blank", "phone", "email", "name", "unknown"))
        + f", count(*) FILTER ({day(c)} IS NOT NULL) AS date_cells FROM ({PERSONS_SQL}) t"
        for i, (header, c, role) in enumerate(ROLE_CELLS)
    ),
    "dedupe_first": one_per_key("event_id"),
    "dedupe_last": one_per_key("event_id DESC"),
    "dedupe_latest": one_per_key("day DESC, event_id DESC"),
    "dedupe_removed": f"""
        SELECT 'key_duplicate' AS _removed_reason, event_id, user_id, event_type FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) r WHERE n > 1""",
    "full_duplicates": f"""
        SELECT event_id AS _row_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY event_id) > 1
          THEN 'full_duplicate' END AS _removed_reason FROM ({EVENTS}) e""",
    "drop_blank_rows": f"SELECT _row_id, CASE WHEN {ALL_BLANK} THEN 'blank_row' END AS _removed_reason FROM ({PERSONS_SQL}) t",
    "kept_and_removed": f"""
        SELECT part, count(*) AS n_rows FROM (
          SELECT CASE WHEN b THEN 'blank_row' WHEN copy > 1 THEN 'full_duplicate'
            WHEN NOT {blank('phone')} AND row_number() OVER (PARTITION BY b, copy > 1, {text('phone')} ORDER BY _row_id) > 1 THEN 'key_duplicate' ELSE 'kept' END AS part
          FROM (SELECT *, row_number() OVER (PARTITION BY b, name, phone, email, last_order, city ORDER BY _row_id) AS copy
                FROM (SELECT *, ({ALL_BLANK}) AS b FROM ({PERSONS_SQL}) t) x) y) z GROUP BY part""",
    "result_row_number": f"""
        SELECT event_id, row_number() OVER (ORDER BY event_id) AS result_row FROM ({one_per_key('event_id')}) k""",
    "occurrence_number": "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events",
    "clean_counts": f"""
        SELECT count(*) AS original_rows, count(*) FILTER (reason IS NULL) AS cleaned_rows, count(*) FILTER (reason IS NOT NULL) AS deleted_rows,
          count(*) FILTER (reason = 'blank_row') AS blank_deleted, count(*) FILTER (reason = 'full_duplicate') AS duplicate_deleted,
          count(*) FILTER (reason = 'key_duplicate') AS field_deleted,
          cast(coalesce(sum(n_fixes) FILTER (reason IS NULL), 0) as bigint) AS fixed_cells,
          count(*) FILTER (reason IS NULL AND reasons <> '') AS review_rows FROM ({cleaned()}) c""",
    "clean_job": f"SELECT result_row, n3 AS name, p3 AS phone, e3 AS email, d3 AS last_order, city FROM ({kept_rows(PERSONS_TEXT_SQL)}) k",
    "clean_latest_job": f"""
        SELECT row_number() OVER (ORDER BY recency, _row_id) AS result_row, name, phone, email, last_order, city FROM (
          SELECT _row_id, name, phone, email, last_order, city, recency,
            row_number() OVER (PARTITION BY {text('phone')} ORDER BY recency DESC, _row_id DESC) AS n FROM (
              SELECT *, CASE WHEN {blank('last_order')} THEN '0' ELSE '1' || last_order END AS recency FROM (
                SELECT _row_id, {TRIMMED} AS name, phone, email, coalesce({iso(day('last_order'))}, last_order) AS last_order, city
                FROM ({PERSONS_TEXT_SQL}) t WHERE NOT ({ALL_BLANK})) f) r) x
        WHERE n = 1 OR {blank('phone')}""",
    "report_bundle": f"""
        WITH c AS ({cleaned(PERSONS_TEXT_SQL)}), kept AS ({kept_rows(PERSONS_TEXT_SQL)}), fx AS ({fix_entries('kept')})
        SELECT 'quality' AS report, 1::bigint AS n_rows UNION ALL SELECT 'summary', 1
        UNION ALL SELECT 'review_view', count(*) FROM kept UNION ALL SELECT 'fixed', count(*) FROM fx
        UNION ALL SELECT 'review', count(*) FROM kept WHERE reasons <> '' UNION ALL SELECT 'removed', count(*) FROM c WHERE reason IS NOT NULL""",
    "merge_tables": "SELECT file AS 来源文件, " + ", ".join(f'c{i} AS "{n}"' for i, n in enumerate(MERGED_NAMES)) + f" FROM ({MERGED}) m",
    "null_stats": f'SELECT file, "column", rows, filled, empty, note FROM ({STATS}) s',
    "alignment_warnings": WARNINGS,
    "alignment_groups": f"""
        WITH st AS ({STATS}), c AS (
          SELECT "column", pos, count(*) FILTER (filled > 0) AS f, count(*) FILTER (filled = 0) AS m,
            coalesce(string_agg(ord::VARCHAR, ',' ORDER BY ord) FILTER (filled > 0), '') AS ins,
            coalesce(string_agg(ord::VARCHAR, ',' ORDER BY ord) FILTER (filled = 0), '') AS outs
          FROM st GROUP BY "column", pos),
        g AS (SELECT ins, arg_min("column", pos) AS name FROM c WHERE f > 0 AND m > 0 GROUP BY ins)
        SELECT c."column", c.pos::INTEGER AS position, a.name AS "group", b.name AS twin_group, c.f AS filled_sources, c.m AS missing_sources
        FROM c JOIN g a ON a.ins = c.ins LEFT JOIN g b ON b.ins = c.outs WHERE c.f > 0 AND c.m > 0""",
    "compare_keys": """
        WITH cells AS (
          SELECT 'l' AS side, '状态' AS "column", 0 AS position, false AS hinted, o_orderstatus::VARCHAR AS cell FROM orders
          UNION ALL SELECT 'l', '客户编号', 1, true, o_custkey::VARCHAR FROM orders
          UNION ALL SELECT 'l', '订单号', 2, true, o_orderkey::VARCHAR FROM orders
          UNION ALL SELECT 'r', '状态', 0, false, l_linestatus::VARCHAR FROM lineitem
          UNION ALL SELECT 'r', '客户编号', 1, true, l_partkey::VARCHAR FROM lineitem
          UNION ALL SELECT 'r', '订单号', 2, true, l_orderkey::VARCHAR FROM lineitem),
        n AS (SELECT "column", position, hinted, count(*) FILTER (side = 'l') AS rl, count(*) FILTER (side = 'r') AS rr,
            count(DISTINCT cell) FILTER (side = 'l') AS cl, count(DISTINCT cell) FILTER (side = 'r') AS cr, count(DISTINCT cell) AS c
          FROM cells GROUP BY ALL),
        f AS (SELECT "column", position, hinted, cl > 0 AND cl >= 0.9 * rl AS unique_left, cr > 0 AND cr >= 0.9 * rr AS unique_right,
            least(cl, cr) > 0 AND cl + cr - c >= 0.5 * least(cl, cr) AS "overlaps" FROM n)
        SELECT *, row_number() OVER (ORDER BY (unique_left AND unique_right AND "overlaps") DESC, "overlaps" DESC, hinted DESC, position)::INTEGER AS rank FROM f""",
    "header_matrix": " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", 'orders_{s}.csv' AS file, '{OWN_HEADERS[s].get(p, '—（本表无此列）')}' AS header"
        for s in SLICES
        for p, name in enumerate(MERGED_NAMES)
    ),
    "merge_summary": f"""
        SELECT (SELECT count(DISTINCT ord) FROM ({MERGED}) a) AS files, (SELECT count(*) FROM ({MERGED}) b) AS rows,
          {len(MERGED_NAMES) + 1}::bigint AS columns, (SELECT count(*) FROM ({WARNINGS}) w) AS warnings""",
    "split_manifest": """
        SELECT event_type AS file_label, event_type AS value, count(*) AS n_rows, min(event_id) AS first_row, '' AS note,
          row_number() OVER (ORDER BY min(event_id)) AS seq FROM events GROUP BY event_type""",
    "split_labels": f"""
        SELECT label || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END AS file_label, value, n_rows, first_row,
          CASE WHEN value IS NULL THEN 'blank_key' WHEN nth > 1 THEN 'renamed' ELSE '' END AS note FROM (
          SELECT *, row_number() OVER (PARTITION BY label ORDER BY value IS NOT NULL, first_row) AS nth FROM (
            SELECT {safe('value')} AS label, value, count(*) AS n_rows, min(rid) AS first_row
            FROM (SELECT rid, CASE WHEN NOT {blank('model', 'split')} THEN model END AS value FROM ({PART_MODELS}) p) v GROUP BY value) g) h""",
    "split_files": f"""
        SELECT *, row_number() OVER (ORDER BY value IS NOT NULL, first_row) AS seq, n_rows AS written_rows FROM ({BRAND_PARTS}) b""",
    "split_report": f"""
        SELECT note AS kind, file_label, value, n_rows FROM ({BRAND_PARTS}) b WHERE note <> ''
        UNION ALL SELECT 'summary', count(*) || ',' || count(*) FILTER (note <> '') || ',0', NULL, cast(sum(n_rows) AS bigint) FROM ({BRAND_PARTS}) c""",
    "split_rows_report": """
        WITH n AS (SELECT count(*) AS rows, (count(*) + 699) // 700 AS parts FROM orders)
        SELECT 'short' AS kind, '第' || parts || '批_700行' AS file_label, NULL::VARCHAR AS value, rows % 700 AS n_rows FROM n WHERE rows % 700 > 0
        UNION ALL SELECT 'summary', parts || ',' || (rows % 700 > 0)::INT || ',0', NULL, rows FROM n""",
    "split_by_source": """
        WITH parts AS (SELECT 'orders_' || o_orderstatus || '.csv' AS name, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1),
          skipped AS (SELECT x AS name FROM (VALUES ('orders_F.csv'), ('orders_O.csv'), ('orders_P.csv'), ('orders_X.csv')) t(x)
                      WHERE x NOT IN (SELECT name FROM parts))
        SELECT 'part' AS kind, name AS file_label, name AS value, n AS n_rows FROM parts
        UNION ALL SELECT 'skipped_empty', NULL, name, 0 FROM skipped
        UNION ALL SELECT 'summary', (SELECT count(*) FROM parts) || ',' || (SELECT count(*) FROM skipped) || ',' || (SELECT count(*) FROM skipped), NULL,
          (SELECT cast(coalesce(sum(n), 0) AS bigint) FROM parts)""",
    "split_blank_key": f"SELECT _row_id, phone FROM ({PERSONS_SQL}) t WHERE {blank('name', 'split')}",
    "split_written": f"""
        SELECT CASE WHEN NOT {blank('city', 'split')} THEN city END AS part, count(*) AS n_rows, count(*) FILTER (NOT {blank('phone')}) AS phones
        FROM ({PERSONS_SQL}) t GROUP BY 1""",
    "chunk_by_rows": """
        SELECT chunk, '第' || chunk || '批_1000行' AS file_label, n_rows, CASE WHEN n_rows < 1000 THEN 'short' ELSE '' END AS note FROM (
          SELECT (i - 1) // 1000 + 1 AS chunk, count(*) AS n_rows FROM (SELECT row_number() OVER () AS i FROM lineitem) r GROUP BY 1) c""",
    "chunk_rows_ordered": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 + 1 AS chunk FROM orders",
    "compare_status": f"SELECT cast(customer as varchar) AS key, ord, result AS status FROM ({COMPARED}) c",
    "compare_changed": f"""
        SELECT cast(customer as varchar) AS key, ord, changed_fields, sa AS "status_A", sb AS "status_B", pa AS "priority_A", pb AS "priority_B"
        FROM ({COMPARED}) c WHERE result = 'changed'""",
    "compare_summary": f"""
        SELECT count(ra) AS rows_a, count(rb) AS rows_b, count(*) FILTER (result LIKE 'only_a%') AS only_a,
          count(*) FILTER (result LIKE 'only_b%') AS only_b, count(*) FILTER (result = 'changed') AS changed,
          count(*) FILTER (result = 'same') AS same FROM ({COMPARED}) c""",
    "difference_list": f"""
        SELECT ord, result,
          CASE WHEN result LIKE 'only_a%' THEN ca WHEN result LIKE 'only_b%' THEN cb END AS customer,
          CASE WHEN result LIKE 'only_a%' THEN pa WHEN result LIKE 'only_b%' THEN pb END AS priority,
          CASE WHEN result LIKE 'only_a%' THEN sa WHEN result LIKE 'only_b%' THEN sb END AS status,
          CASE WHEN result = 'changed' THEN ca END AS "customer_A", CASE WHEN result = 'changed' THEN cb END AS "customer_B",
          CASE WHEN result = 'changed' THEN pa END AS "priority_A", CASE WHEN result = 'changed' THEN pb END AS "priority_B",
          CASE WHEN result = 'changed' THEN sa END AS "status_A", CASE WHEN result = 'changed' THEN sb END AS "status_B",
          CASE WHEN result = 'changed' THEN changed_fields END AS changed_fields
        FROM ({COMPARED}) c WHERE result <> 'same'""",
    "only_in": f"""
        SELECT _row_id AS o_orderkey, customer, status FROM ({ORDERS_LATER_SQL}) l
        WHERE customer NOT IN (SELECT o_custkey FROM orders)""",
    "scan_roundtrip": f"""
        SELECT nullif(nullif(name, ''), 'NaN') AS name, CASE WHEN {blank('phone')} THEN NULL ELSE {trim('phone')} END AS phone,
          CASE WHEN {trim('email')} = '' THEN NULL ELSE email END AS email,
          CASE WHEN last_order LIKE '____%-%' AND {day('last_order')} IS NOT NULL AND last_order NOT LIKE '%:%' THEN {iso(day('last_order'))}
               WHEN regexp_full_match(last_order, '\\d{{4}}/\\d+/\\d+') THEN {iso(day('last_order'))} ELSE last_order END AS last_order, city
        FROM ({PERSONS_SQL}) t""",
    "scan_many_headers": f"""
        SELECT CASE WHEN name = 'NaN' THEN NULL ELSE name END AS "姓名", CASE WHEN {blank('phone')} THEN NULL ELSE {trim('phone')} END AS "手机号",
          CASE WHEN _row_id % 3 <> 0 THEN city END AS city FROM ({PERSONS_SQL}) t""",
    "scan_odd_cells": """
        SELECT 'k' || doc_id AS k, length(text) + 3 AS n FROM documents
        UNION ALL SELECT 'cell ' || CASE WHEN doc_id % 3 > 0 THEN 'd' || (doc_id % 5) ELSE '-' END, count(*) FROM documents GROUP BY 1""",
    "scan_split_cells": """
        SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN '"' ELSE '' END || text || chr(13) || chr(10) || '"",') AS hash,
          NULL::VARCHAR AS none, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents""",
    "scan_folder_kv": "SELECT p_partkey, p_brand FROM part WHERE p_partkey % 3 > 0",
    "reserved_headers": """
        SELECT DISTINCT event_type AS kind, (event_id % 7)::VARCHAR AS _chunk, (event_id % 3)::VARCHAR AS _row_id,
          '_file' || event_id % 2 AS _file, '_place' || event_id % 2 AS _place, '_name' || event_id % 2 AS _name,
          '_unique' || event_id % 2 AS _unique, '_won' || event_id % 2 AS _won, '_at' || event_id % 2 AS _at,
          '_offset' || event_id % 2 AS _offset, '_n' || event_id % 2 AS _n, '_key' || event_id % 2 AS _key,
          '_block' || event_id % 2 AS _block, '_local' || event_id % 2 AS _local FROM events""",
    "merge_ordered": """
        SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS place
        FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')""",
    "merge_widened": """
        SELECT 'a' AS 来源文件, round(sum(p_size)::DOUBLE, 2) AS total, round(max(p_size)::DOUBLE, 2) AS most,
          sum(p_size::DECIMAL(28,2))::VARCHAR AS ids FROM part
        UNION ALL SELECT 'b', round(sum(p_partkey)::DOUBLE, 2), round(max(p_partkey)::DOUBLE, 2),
          sum((p_partkey + 9007199254740992)::DECIMAL(28,2))::VARCHAR FROM part
        UNION ALL SELECT 'c', round(sum(p_retailprice), 2), round(max(p_retailprice), 2), sum(p_retailprice::DECIMAL(28,2))::VARCHAR FROM part""",
    "occurrence_blocks": """
        SELECT event_id * 100003 AS _row_id, nullif(event_type, 'click') AS kind,
          row_number() OVER (PARTITION BY nullif(event_type, 'click') ORDER BY event_id) AS nth FROM events""",
    "positions_blocks": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 + 1 AS chunk FROM orders",
    "compare_blocks": f"SELECT cast(customer as varchar) AS key, ord, result AS status FROM ({COMPARED}) c",
    "row_id_ties": """
        SELECT reason AS _removed_reason, count(*) AS n, count(*) AS ids FROM (
          SELECT CASE WHEN row_number() OVER (PARTITION BY p_size, p_brand) > 1 THEN 'full_duplicate' END AS reason FROM part) p GROUP BY 1""",
    "fix_log_ordered": f"""
        SELECT cast(coalesce(sum(n_fixes), 0) as bigint) AS n, 0::BIGINT AS out_of_order, 0::BIGINT AS files_out_of_order
        FROM ({cleaned()}) c WHERE reason IS NULL""",
    "compare_ordered": f"""
        SELECT count(*) AS n, 0::BIGINT AS out_of_order, 0::BIGINT AS files_out_of_order FROM ({COMPARED}) c WHERE result <> 'same'""",
    "split_ordered": "SELECT event_type, count(*) AS n, 0::BIGINT AS out_of_order FROM events GROUP BY 1",
}
