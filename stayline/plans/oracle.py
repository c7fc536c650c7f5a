"""The queries of the catalog as plain SQL, written independently of the Spark code.

Each text runs on DuckDB over the same tables. Queries without an entry fit a
model or otherwise have no SQL form.
"""

from __future__ import annotations

from stayline.fields import FEATURES, NUMERIC_FEATURES, REQUIRED_FIELDS

# --- Shared views ---------------------------------------------------------------

BASE = """base as (
select c.c_custkey as "RowNumber", c.c_custkey as "CustomerId", c.c_name as "Surname",
 cast(300 + 50*coalesce(f.n_done,0) as double) as "CreditScore",
 r.r_name as "Geography", c.c_mktsegment as "Gender",
 cast(coalesce(f.n_orders,0) as double) as "Age",
 cast(coalesce(f.tenure,0) as double) as "Tenure",
 c.c_acctbal as "Balance",
 cast(coalesce(f.n_prio,0) as double) as "NumOfProducts",
 cast(coalesce(f.has_urgent,0) as double) as "HasCrCard",
 cast(coalesce(f.active,0) as double) as "IsActiveMember",
 f.max_price as "EstimatedSalary",
 case when l.k is null then 1 else 0 end as "Exited"
from customer c
join nation n on n.n_nationkey = c.c_nationkey
join region r on r.r_regionkey = n.n_regionkey
left join (
  select o_custkey k, count(*) n_orders,
   sum(case when o_orderstatus='F' then 1 else 0 end) n_done,
   count(distinct o_orderpriority) n_prio,
   max(case when o_orderpriority like '1%' then 1 else 0 end) has_urgent,
   max(case when o_orderdate >= timestamp '1999-08-01 00:00:00' then 1 else 0 end) active,
   2000 - min(extract(year from o_orderdate)) tenure,
   max(o_totalprice) max_price
  from orders where o_orderdate < timestamp '2000-08-01 00:00:00'
  group by o_custkey) f on f.k = c.c_custkey
left join (
  select distinct o_custkey k from orders
  where o_orderdate >= timestamp '2000-08-01 00:00:00') l on l.k = c.c_custkey
)"""

SCORED = """scored as (
select z.* exclude (z), round(1e0/(1e0+exp(-z)),6) as p_churn,
 case when (("CustomerId"*7919) % 1000)/1000e0 < 1e0/(1e0+exp(-z)) then 1 else 0 end as "Churned"
from (select base.*, -0.1e0 - 1.8e0*"IsActiveMember" - 0.25e0*("Age"-9)
        + case when "Geography"='EUROPE' then 0.6e0 else 0e0 end
        + "Balance"*0.0001e0 as z from base) z
)"""

CLV = """(greatest(0e0, "Balance") * (1e0 + greatest(0e0, "Tenure")/10e0)
  + 0.05e0*greatest(0e0, coalesce("EstimatedSalary", 0e0)))"""

ACTION = """case when p_churn < 0.3e0 then 'No action' when p_churn < 0.6e0 then 'Retention email'
  when p_churn >= 0.6e0 then 'Discount or retention call' end"""

COST = """case recommended_action when 'Retention email' then 5e0
  when 'Discount or retention call' then 50e0 else 0e0 end"""

DECIDED = f"""valued as (select scored.*, {CLV} as clv, {ACTION} as recommended_action from scored),
decided as (select valued.*, p_churn*clv - {COST} as net_gain from valued)"""

ADDRESS = """case when "CustomerId" % 11 = 2 then ' ' when "CustomerId" % 13 = 1 then 'not-an-email'
      else concat('  User', cast("CustomerId" as varchar), '@Example.COM ') end"""

RAW = f"""raw_records as (
select "CustomerId" as row_index, concat('cust-', cast("CustomerId" as varchar)) as customer_id,
 case when "CustomerId" % 31 = 7 then '1.0d' else cast("CreditScore" as varchar) end as "CreditScore",
 "Geography",
 case when "CustomerId" % 23 = 5 then '' else "Gender" end as "Gender",
 case when "CustomerId" % 17 = 3 then null else cast("Age" as varchar) end as "Age",
 case when "CustomerId" % 29 = 6 then '  ' else cast("Tenure" as varchar) end as "Tenure",
 case when "CustomerId" % 19 = 4 then 'bad' else cast("Balance" as varchar) end as "Balance",
 cast("NumOfProducts" as varchar) as "NumOfProducts",
 cast("HasCrCard" as varchar) as "HasCrCard",
 cast("IsActiveMember" as varchar) as "IsActiveMember",
 case when "CustomerId" % 37 = 8 then 'NaN' else cast(coalesce("EstimatedSalary",0) as varchar) end as "EstimatedSalary",
 {ADDRESS} as email
from base
)"""

RESULTS = f"""results as (
select "CustomerId" as "index",
 case when "CustomerId" % 10 = 0 then null when "CustomerId" % 10 = 5 then ' '
   else concat(' cust-', cast("CustomerId" as varchar), ' ') end as id,
 {ADDRESS} as email,
 case when "CustomerId" % 4 = 0 then null when "CustomerId" % 4 = 1 then '  ' else "Surname" end as name,
 case when "CustomerId" % 13 = 0 then null when "CustomerId" % 17 = 0 then 'NaN'::double
   when "CustomerId" % 19 = 0 then 'Infinity'::double when "CustomerId" % 23 = 0 then 1.5e0 else p_churn end as p_churn,
 case when "CustomerId" % 7 = 0 then null when "CustomerId" % 7 = 1 then '  ' else recommended_action end as recommended_action,
 clv, net_gain
from decided
)"""

# Results with p limited to finite values, and cleaned id, e-mail and name.
CLEAN = """clean as (
select "index", nullif(trim(id), '') as given_id, lower(trim(email)) as address,
 nullif(trim(name), '') as name, case when isfinite(p_churn) then p_churn end as p,
 nullif(trim(recommended_action), '') as action, recommended_action, net_gain
from results),
contact as (
select clean.* exclude (address), case when regexp_full_match(address, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') then address end as email,
 coalesce(given_id, concat('idx-', cast("index" as varchar))) as id
from clean)"""

SPLIT = """ranked as (
select scored.*, row_number() over (partition by "Churned" order by md5('42-' || cast("CustomerId" as varchar)), "CustomerId") as r,
 count(*) over (partition by "Churned") as n from scored),
sets as (select ranked.*, case when r <= round(0.2e0*n) then 'test' else 'train' end as split from ranked)"""

NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def _problem_view() -> str:
    missing = [
        f"""select row_index, customer_id as id, {i} as place, '{f}' as field, 'Missing required field: {f}' as message
 from raw_records where "{f}" is null or "{f}" = ''"""
        for i, f in enumerate(REQUIRED_FIELDS)
    ]
    wrong = [
        f"""select row_index, customer_id as id, {i} as place, '{f}' as field,
 concat('Field ''{f}'' must be a number (got ''', "{f}", ''')') as message
 from raw_records where not regexp_full_match(trim("{f}"), '{NUMBER}')
  and row_index not in (select row_index from missing)"""
        for i, f in enumerate(NUMERIC_FEATURES)
    ]
    return (
        "missing as (" + " union all ".join(missing) + "),\nwrong as (" + " union all ".join(wrong) + "),\n"
        "problems as (select row_index, id, cast(row_number() over (partition by row_index order by place) - 1 as integer) as error_no,"
        " field, message from (select * from missing union all select * from wrong))"
    )


PROBLEMS = _problem_view()

VALID = (
    "valid as (select row_index, customer_id as id, "
    + ", ".join(f'cast("{f}" as double) as "{f}"' if f in NUMERIC_FEATURES else f'"{f}"' for f in FEATURES)
    + ", email from raw_records where row_index not in (select row_index from problems))"
)

VALID_SCORED = f"""valid_p as (select valid.*, round(1e0/(1e0+exp(-(-0.1e0 - 1.8e0*"IsActiveMember" - 0.25e0*("Age"-9)
  + case when "Geography"='EUROPE' then 0.6e0 else 0e0 end + "Balance"*0.0001e0))),6) as p_churn from valid),
valid_valued as (select valid_p.*, {CLV} as clv, {ACTION} as recommended_action from valid_p),
batch as (select row_index as "index", id, case when p_churn >= 0.5e0 then 1 else 0 end as predicted_label, p_churn, clv,
  recommended_action, p_churn*clv - {COST} as net_gain, email from valid_valued)"""

DRAFTS = r"""drafts as (
select concat('c-', cast(conv_id as varchar), '-', cast(turn as varchar)) as draft_id,
 case when turn % 4 = 3 and conv_id % 6 = 1 then E'  \n '
  when turn % 4 = 1 and conv_id % 2 = 0 then concat('Subject: offer ', cast(conv_id as varchar), E'\n\n\n', text)
  when turn % 4 = 1 then concat('  SUBJECT : offer ', cast(conv_id as varchar), E'\r\n', text, E'\nsubject:again\n')
  when conv_id % 7 = 3 then concat(text, E'\n \n\n  Best regards & "thanks" \n \n') else text end as body
from conversations
union all select concat('p-', cast(page_id as varchar)), html from pages
)"""

GROUPS = r"""draft_groups as (
select conv_id as group_id, draft_no,
 case when turn = 1 and conv_id % 5 = 0 then concat(E'Subject: hi\n', text)
  when turn = 2 and conv_id % 9 = 0 then concat('<b>', text, '</b>')
  when turn = 0 and conv_id % 11 = 0 then '   ' else text end as body
from (select *, row_number() over (partition by conv_id order by turn) as draft_no from conversations)
)"""

# Lines of a text, stripped.
SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{2028}\x{2029}]"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def lines(text: str) -> str:
    breaks = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
    return f"list_transform(regexp_split_to_array({text}, '{breaks}'), lambda l: {strip('l')})"


def untag(text: str) -> str:
    return f"regexp_replace({text}, '<[^>]+>', '', 'g')"


def collapse(list_text: str) -> str:
    """Lines joined, runs of blank lines as one blank line, none at the ends."""
    return strip(rf"regexp_replace(array_to_string({list_text}, E'\n'), '\n{{3,}}', E'\n\n', 'g')")


UNTAGGED_LINES = lines(untag("body"))
IS_SUBJECT = r"regexp_matches(l, '(?i)^subject\s*:')"
HAS_SUBJECT = rf"len(list_filter({lines('body')}, lambda l: {IS_SUBJECT})) > 0"
PROBLEM = f"""case when {strip('body')} = '' then 'empty' when contains(body, '<') or contains(body, '>') then 'html'
 when {HAS_SUBJECT} then 'subject' else 'ok' end"""

SETS = f"""sides as (
select group_id, count(*) as n_drafts, max(case when draft_no=1 then body end) as draft_1, max(case when draft_no=2 then body end) as draft_2,
 max(case when draft_no=3 then body end) as draft_3 from draft_groups group by group_id),
draft_sets as (
select group_id, draft_1, draft_2, draft_3, case when group_id % 8 = 0 then concat('  ', draft_2, E' \\n') when group_id % 8 = 1 then 'I choose Draft 3.'
 when group_id % 8 = 2 then 'option2 please' when group_id % 8 = 3 then 'the SECOND one'
 when group_id % 8 = 4 then 'Third is best, of 13 reasons' when group_id % 8 = 5 then '' when group_id % 8 = 6 then draft_3 end as answer
from sides where n_drafts = 3),
normal as (
select group_id, {strip("coalesce(answer, '')")} as said, {collapse(lines('draft_1'))} as d1, {collapse(lines('draft_2'))} as d2,
 {collapse(lines('draft_3'))} as d3 from draft_sets),
numbered as (select normal.*, regexp_extract(said, '(?i)\\b(?:draft|option)?\\s*([123])\\b', 1) as num from normal),
chosen as (
select group_id, d1, d2, d3, case when said in (d1, d2, d3) then said when num = '1' then d1 when num = '2' then d2 when num = '3' then d3
 when contains(lower(said), 'first') then d1 when contains(lower(said), 'second') then d2 when contains(lower(said), 'third') then d3
 else d1 end as chosen from numbered)"""

LOG = """send_log as (
select event_id as id, case when event_id % 50 = 7 then 'queued' end as status,
 case when event_type = 'click' then true when event_type = 'view' and event_id % 3 = 0 then false end as ok,
 case when event_type in ('purchase','signup') then 202 when event_type = 'error' then 500 end as status_code
from events),
outcomes as (
select send_log.*, coalesce(ok, case when status_code is not null then status_code between 200 and 299 end, status is not null) as sent_ok,
 coalesce(status, case when ok then 'sent' when not ok then 'error' end,
   case when status_code between 200 and 299 then 'sent' when status_code is not null then 'error' end, 'sent') as send_status
from send_log)"""

HIST = """hist as (select p_churn as s, count(*) as n, sum("Churned") as pos from scored group by 1),
run as (select hist.*, sum(n) over w as cn, sum(pos) over w as cp, sum(n) over () as tn, sum(pos) over () as tp
  from hist window w as (order by s desc rows unbounded preceding))"""

CONFUSION = """confusion as (
select sum(case when "Churned"=0 and p_churn < 0.5e0 then 1 else 0 end)::bigint as tn,
 sum(case when "Churned"=0 and p_churn >= 0.5e0 then 1 else 0 end)::bigint as fp,
 sum(case when "Churned"=1 and p_churn < 0.5e0 then 1 else 0 end)::bigint as fn,
 sum(case when "Churned"=1 and p_churn >= 0.5e0 then 1 else 0 end)::bigint as tp from scored)"""

RATES = {
    "accuracy": "(tp+tn)/cast(tn+fp+fn+tp as double)",
    "precision": "case when tp+fp=0 then 0e0 else tp/cast(tp+fp as double) end",
    "recall": "case when tp+fn=0 then 0e0 else tp/cast(tp+fn as double) end",
    "f1": "case when tp=0 then 0e0 else 2e0*tp/(2e0*tp+fp+fn) end",
    "balanced_accuracy": "(tp/cast(tp+fn as double) + tn/cast(tn+fp as double))/2e0",
}
AUC = "sum((n-pos)*(cast(cp as double) - pos + pos/2e0)) / (max(tp)*cast(max(tn-tp) as double))"
AP = "sum(cast(pos as double)*cp/cn) / max(tp)"


def rates(*names: str) -> str:
    return ", ".join(f"round({RATES[n]},6) as {n}" for n in names)


def with_(*views: str, body: str) -> str:
    return "with " + ",\n".join(views) + "\n" + body


def lift_sql(score: str, sizes: str) -> str:
    """Precision, recall and lift at the sizes in (k, kind) rows, by plain ranking."""
    return with_(
        BASE,
        SCORED,
        f"""ranked as (select "Churned" as y, row_number() over (order by {score} desc, "CustomerId") as r,
  count(*) over () as n, sum("Churned") over () as p from scored)""",
        f"ks(k, kind) as (values {sizes})",
        """cuts as (select k, kind, cast(case when kind = 'share' then greatest(1, ceil(n*k)) else k end as bigint) as size, n, p
  from ks, (select max(n) n, max(p) p from ranked))""",
        body="""select k, kind, size, round(hits/cast(size as double),6) as precision_at_k,
 round(hits/cast(p as double),6) as recall_at_k, round((hits/cast(size as double))/(p/cast(n as double)),6) as lift_at_k
from (select cuts.*, (select sum(y) from ranked where r <= cuts.size) as hits from cuts)""",
    )


SHARES = "(0.01e0,'share'),(0.05e0,'share'),(0.1e0,'share'),(0.2e0,'share'),(0.3e0,'share')"
Q = ", ".join(f'"{f}"' for f in FEATURES)
TRAIN = "train as (select * from sets where split = 'train')"
MEDIANS = "medians as (select " + ", ".join(f'median("{f}") as "{f}"' for f in NUMERIC_FEATURES) + " from train)"
FILLED = (
    'filled as (select sets."CustomerId", sets.split, "Churned", "Geography", "Gender", '
    + ", ".join(f'coalesce(sets."{f}", medians."{f}") as "{f}"' for f in NUMERIC_FEATURES)
    + " from sets, medians)"
)
FITTED = (
    "fitted as (select "
    + ", ".join(f'avg("{f}") as "m_{f}", stddev_pop("{f}") as "s_{f}"' for f in NUMERIC_FEATURES)
    + " from filled where split = 'train')"
)
PREP = (BASE, SCORED, SPLIT, TRAIN, MEDIANS, FILLED, FITTED)


def scaled(f: str) -> str:
    return f'round(("{f}" - "m_{f}")/case when "s_{f}" = 0 then 1 else "s_{f}" end, 6)'


LEVELS = """levels as (
select 'Geography' as feature, "Geography" as level from train where "Geography" is not null group by 2
union all select 'Gender', "Gender" from train where "Gender" is not null group by 2),
placed as (select feature, cast(row_number() over (partition by feature order by level) - 1 as integer) as position, level,
 concat(feature, '_', level) as name from levels)"""

GEOGRAPHIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

LINEAR = """models as (
select "CustomerId", "Churned" as y, p_churn as "full",
 round(1e0/(1e0+exp(-(-0.1e0 - 1.8e0*"IsActiveMember"))),6) as activity,
 round(1e0/(1e0+exp(-(-0.1e0 - 0.25e0*("Age"-9)))),6) as orders_only,
 round(1e0/(1e0+exp(-(-0.1e0 + 0.0001e0*"Balance"))),6) as balance_only from scored),
long as (
select 'full' as model, 1 as position, "full" as s, y from models union all
select 'activity', 2, activity, y from models union all
select 'orders', 3, orders_only, y from models union all
select 'balance', 4, balance_only, y from models),
hist as (select model, position, s, count(*) as n, sum(y) as pos from long group by 1, 2, 3),
run as (select hist.*, sum(n) over w as cn, sum(pos) over w as cp, sum(n) over (partition by model) as tn,
  sum(pos) over (partition by model) as tp from hist
  window w as (partition by model order by s desc rows unbounded preceding))"""
BOARD = f"board as (select model, position, round({AUC},6) as roc_auc from run group by model, position)"

def reach(shift: bool) -> str:
    """Rows above the threshold with the address of their record; positions as given or partly out of range."""
    position = 'case when r."index" % 6 = 1 then -r."index" else r."index" end' if shift else 'r."index"'
    return f"""source as (
select row_index, lower(trim(email)) as address, customer_id from raw_records),
moved as (select {position} as "index", nullif(trim(r.id), '') as given_id, r.p_churn from results r),
reach as (
select m."index", coalesce(m.given_id, s.customer_id) as id, m.p_churn, s.customer_id is not null as in_range,
 case when regexp_full_match(s.address, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') then s.address end as email
from moved m left join source s on s.row_index = m."index"
where isfinite(m.p_churn) and m.p_churn between 0 and 1 and m.p_churn >= 0.65e0)"""


def best_recipients(n: int) -> str:
    return f"""recipients as (
select row_number() over (order by p_churn desc, "index", id) as rank, "index", id, email, p_churn
from reach where in_range and email is not null order by rank limit {n})"""


TARGETS = """targets as (
select row_number() over (order by p desc, given_id is null, given_id, "index") as rank, id, "index", email, name, p as p_churn
from contact where p >= 0.6e0 and email is not null order by rank limit 50)"""
LISTED = """listed as (
select row_number() over (order by starts_with(id, 'idx-'), case when not starts_with(id, 'idx-') then id end, "index") as position, * from targets)"""

DRAFTED = r"""drafted as (
select rank, id, "index", email, p_churn, case when rank % 5 <> 0 then
 concat('Write a serious retention outreach email from Retention Team at Example Co to customer ', id, ' (', email,
 '). Customer churn probability is ', printf('%.2f', p_churn), '. Do not mention scoring. Include one clear next step.',
 E'\n\nContext:\ncompany_name: Example Co\nfrom_name: Retention Team\nfrom_email: retention@example.com') end as body_text,
 concat('Write a serious retention outreach email from Retention Team at Example Co to customer ', id, ' (', email,
 '). Customer churn probability is ', printf('%.2f', p_churn), '. Do not mention scoring. Include one clear next step.') as first_line
from recipients)"""

DRAFT_ERROR = "'writer returned an empty draft'"
FAILED = "'Email provider reported a failed send attempt'"
TARGET_ERRORS = """select 'targeting' as stage, "index" as row_index, case when in_range then id end as id,
 case when in_range then 'Selected row is missing a valid ''email''' else 'Result index is out of range and row was skipped' end as message
from reach where not in_range or email is null"""

RUNS = """runs as (
select b."Geography", count(*) as n, count(*) filter (c.p is not null or c.action is not null) as n_usable,
 count(*) filter (c.p between 0.9e0 and 1) as n_selected, count(*) filter (c.p between 0.9e0 and 1 and c.email is null) as n_errors
from contact c join base b on b."CustomerId" = c."index" group by 1)"""

RESULT_VIEWS = (BASE, SCORED, DECIDED, RESULTS, CLEAN)
RECORD_VIEWS = (BASE, RAW, PROBLEMS, VALID)


def blanked(names: list[str], kept: str = "row_index % 41 <> 9") -> str:
    """Cells as read back from CSV: rows that are not kept (every 41st) empty, missing spellings null."""
    return ", ".join(f'case when {kept} and "{n}" not in (\'\', \'NaN\') then "{n}" end as "{n}"' for n in names)


RAW_NAMES = ["customer_id", "CreditScore", "Geography", "Gender", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember", "EstimatedSalary", "email"]


ORACLE: dict[str, str] = {
    # Sources and sinks
    "src_training_csv": with_(BASE, body="select * from base"),
    "src_batch_csv": with_(
        BASE,
        RAW,
        f"cells as (select row_index as place, {blanked(RAW_NAMES)} from raw_records where row_index % 41 <> 9)",
        body="select row_number() over (order by place) - 1 as row_index, * exclude (place) from cells",
    ),
    "src_quoted_csv": with_(
        BASE,
        RAW,
        f"""cells as (select row_index, {blanked(RAW_NAMES[1:], 'true')}, case when row_index % 5 = 2 then customer_id || chr(10) || 'c/o "'
 || "Geography" || '", 2nd floor' || chr(13) || chr(10) else customer_id end as customer_id from raw_records)""",
        body="select * replace (row_number() over (order by row_index) - 1 as row_index) from cells",
    ),
    "src_json_positions": """select case when c_custkey % 3 > 0 then c_custkey % 7 end as request_id, c_custkey || '-' || i as customer_id,
 row_number() over (order by c_custkey % 3 = 0, case when c_custkey % 3 > 0 then c_custkey % 7 end, c_custkey, i) - 1 as row_index
from customer, range(1, 5) as entry(i) where i <= c_custkey % 4 + 1""",
    "src_json_errors": """select what, count(*) as n from (
select case c_custkey % 10 when 1 then 'Request body must be valid JSON' when 2 then 'Request body is empty'
 when 3 then 'Request body has no list of records' else 'record, score 1' end as what from customer
union all select 'Record must be a JSON object' from customer, range(3) where c_custkey % 10 = 4) group by what""",
    "src_batch_json": with_(
        BASE,
        RAW,
        body="select *, row_index // 100 as request_id, row_index % 100 as position, 'partial' as mode from raw_records",
    ),
    "sink_tables": with_(
        BASE,
        SCORED,
        SPLIT,
        "parts as (select 'raw' as table_name, * from sets union all select split, * from sets)",
        body="""select table_name, count(*) as n_rows, sum("Churned")::bigint as n_churned, sum("CreditScore") as credit_total
from parts group by 1""",
    ),
    "sink_feature_schema": with_(
        BASE,
        SCORED,
        SPLIT,
        TRAIN,
        LEVELS,
        "numbers(position, name) as (values " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(NUMERIC_FEATURES)) + ")",
        body="""select 'raw' as kind, position, name, 'double' as dtype from numbers
union all select 'raw', 8, 'Geography', 'string' union all select 'raw', 9, 'Gender', 'string'
union all select 'transformed', position, name, 'double' from numbers
union all select 'transformed', cast(8 + position + case when feature = 'Gender' then (select count(*) from placed where feature = 'Geography') else 0 end as integer),
  name, 'double' from placed""",
    ),
    "sink_training_metadata": with_(
        BASE,
        SCORED,
        SPLIT,
        TRAIN,
        LEVELS,
        "hist as (select p_churn as s, count(*) as n, sum(\"Churned\") as pos from sets where split = 'test' group by 1)",
        """run as (select hist.*, sum(n) over w as cn, sum(pos) over w as cp, sum(n) over () as tn, sum(pos) over () as tp
  from hist window w as (order by s desc rows unbounded preceding))""",
        """f as (select 2e0*tp/(2e0*tp+fp+fn) as f1 from (select sum(case when s>=0.5e0 then pos else 0 end) as tp,
  sum(case when s>=0.5e0 then n-pos else 0 end) as fp, sum(case when s<0.5e0 then pos else 0 end) as fn from hist))""",
        body=f"""select '2024-01-01T00:00:00+00:00' as trained_at, 'Logistic Regression' as model_name, '1.0.0' as version,
 'models/linear' as model_path, (select round({AUC},6) from run) as roc_auc, (select round(f1,6) from f) as f1,
 '{",".join(FEATURES)}' as input_columns,
 concat('{",".join(NUMERIC_FEATURES)},', (select string_agg(name, ',' order by feature desc, position) from
   (select * from placed order by feature = 'Gender', position) where feature = 'Geography'), ',',
   (select string_agg(name, ',' order by position) from placed where feature = 'Gender')) as transformed_columns""",
    ),
    "model_metadata_lookup": with_(
        BASE,
        SCORED,
        body="""select case when "CustomerId" % 2 = 0 then 'Logistic Regression' else 'churn_predictor' end as model_name,
 case when "CustomerId" % 2 = 0 then concat('2.0.', (select count(*) from scored)) else '1.0.0' end as model_version,
 count(*) as n_rows from scored group by 1, 2""",
    ),
    # Projections and predicates
    "proj_drop_ids": with_(BASE, body='select * exclude ("RowNumber", "CustomerId", "Surname") from base'),
    "proj_features": with_(BASE, body=f"select {Q} from base"),
    "proj_model_input": with_(BASE, RAW, body=f"select {Q} from raw_records"),
    "proj_reindex": with_(
        BASE,
        body="select "
        + ", ".join(f'"{f}"' for f in NUMERIC_FEATURES)
        + """, 0e0 as "Geography_ATLANTIS", cast("Geography"='EUROPE' as double) as "Geography_EUROPE",
 cast("Gender"='BUILDING' as double) as "Gender_BUILDING" from base""",
    ),
    "filter_usable_predictions": with_(
        *RESULT_VIEWS, body='select "index", p as p_churn, recommended_action from clean where p is not null or action is not null'
    ),
    "filter_allowed_actions": with_(
        *RESULT_VIEWS,
        body="""select "index", recommended_action, 'two' as list from results
 where recommended_action in ('Retention email', 'Discount or retention call')
union all select "index", recommended_action, 'empty' from results""",
    ),
    "probability_coerce": with_(
        BASE,
        SCORED,
        body="""select "CustomerId" as "index", case "CustomerId" % 5 when 2 then 0.25e0 when 4 then p_churn end as p from scored""",
    ),
    "probability_range": with_(*RESULT_VIEWS, body='select "index", case when p between 0 and 1 then p end as p from clean'),
    # Validation
    "val_missing": with_(BASE, RAW, PROBLEMS, body="select row_index, field, message from missing"),
    "val_numeric": with_(BASE, RAW, PROBLEMS, body="select * from problems where message like 'Field %'"),
    "val_errors": with_(BASE, RAW, PROBLEMS, body="select * from problems"),
    "val_valid_rows": with_(*RECORD_VIEWS, body="select * exclude (email) from valid"),
    "val_partial": with_(
        *RECORD_VIEWS,
        VALID_SCORED,
        body="""select "index" as row_index, id, 'valid' as kind, p_churn, null::varchar as message from batch
union all select row_index, id, 'error', null, message from problems""",
    ),
    "val_fail_fast": with_(
        *RECORD_VIEWS,
        "stop as (select min(row_index) as spot from problems)",
        body="""select problems.*, (select count(*) from raw_records where row_index < spot) as valid_records, cast(0 as bigint) as n_results
from problems, stop where row_index = spot""",
    ),
    "val_summary": with_(
        *RECORD_VIEWS,
        "stop as (select min(row_index) as spot from problems)",
        body="""select (select count(*) from raw_records) as total_records, (select count(*) from valid) as valid_records,
 (select count(distinct row_index) from problems) as invalid_records, (select count(*) from problems) as error_count, 'partial' as mode
union all select (select count(*) from raw_records), (select count(*) from raw_records, stop where row_index < spot),
 (select count(distinct row_index) from problems, stop where row_index = spot), (select count(*) from problems, stop where row_index = spot), 'fail_fast'""",
    ),
    "val_status": with_(
        *RECORD_VIEWS,
        """counts as (select 'all' as records, (select count(*) from valid) as v, (select count(*) from problems) as e
  union all select 'good rows', (select count(*) from valid), 0
  union all select 'bad rows', 0, (select count(*) from problems) union all select 'no rows', 0, 0)""",
        "modes(mode) as (values ('partial'), ('fail_fast'))",
        body="""select records, mode, case when e > 0 and mode = 'fail_fast' then 'error' when e > 0 and v = 0 then 'failed'
 when e > 0 then 'partial' else 'success' end as status from counts, modes""",
    ),
    "record_id_batch": with_(
        BASE,
        RAW,
        body="""select row_index, case when row_index % 3 <> 0 then customer_id when row_index % 2 <> 0 then cast(row_index as varchar) end as record_id
from raw_records""",
    ),
    "record_id_outreach": with_(
        BASE,
        RAW,
        body="""select row_index, case when row_index % 5 = 1 then concat('id-', cast(row_index as varchar)) when row_index % 3 <> 0 then customer_id
 when row_index % 2 <> 0 then cast(row_index as varchar) else concat('idx-', cast(row_index as varchar)) end as record_id from raw_records""",
    ),
    # Splits
    "split_stratified": with_(BASE, SCORED, SPLIT, body='select "CustomerId", "Churned", split from sets'),
    "split_unstratified": """select "CustomerId", case when r <= round(0.2e0*n) then 'test' else 'train' end as split from (
 select c_custkey as "CustomerId", row_number() over (order by md5('42-' || cast(c_custkey as varchar)), c_custkey) as r,
 count(*) over () as n from customer)""",
    "kfold_stratified": with_(
        BASE, SCORED, SPLIT, body='select "CustomerId", "Churned", cast(floor((r-1)*3/cast(n as double)) as integer) as fold from ranked'
    ),
    # Training: what was split off, tried and accepted; the fits themselves are checked in pytest.
    "sink_model": "select count(*) as n_rows, count(*) as n_same from customer",
    "score_model": 'select c_custkey as "CustomerId", true as p_matches, true as label_matches from customer',
    **{
        key: with_(
            BASE,
            SCORED,
            SPLIT,
            body=f"""select '{model}' as model, count(*) filter (split = 'train') as n_train, count(*) filter (split = 'test') as n_test,
 count(*) filter (split = 'test' and "Churned" = 1) as n_test_churned, {tried} as n_settings, true as accepted from sets""",
        )
        for key, model, tried in (
            ("train_logistic", "Logistic Regression", 2),
            ("train_tree", "Decision Tree", 6),
            ("train_forest", "Random Forest", 4),
            ("train_gbt", "Gradient Boosting", 4),
        )
    },
    "train_grid_search": with_(
        BASE,
        SCORED,
        SPLIT,
        "tried(model, n_settings) as (values ('Logistic Regression', 2), ('Decision Tree', 6), ('Random Forest', 4), ('Gradient Boosting', 4))",
        body="""select model, n_settings, (select count(*) from sets where split = 'train') as n_train, true as took_best, true as accepted
from tried""",
    ),
    "train_run": with_(
        BASE,
        SCORED,
        SPLIT,
        body="""select '2024-01-01T00:00:00+00:00' as trained_at, '1.0.0' as version, count(*) as n_test, cast(4 as bigint) as n_models,
 true as took_best, true as accepted from sets where split = 'test'""",
    ),
    # Preparation
    "prep_median_fit": with_(
        BASE,
        SCORED,
        SPLIT,
        TRAIN,
        body=" union all ".join(f"select '{f}' as name, median(\"{f}\") as median from train" for f in NUMERIC_FEATURES),
    ),
    "prep_median_impute": with_(
        *PREP, body='select "CustomerId", ' + ", ".join(f'"{f}"' for f in NUMERIC_FEATURES) + " from filled"
    ),
    "prep_scaler_fit": with_(
        *PREP,
        body=" union all ".join(
            f"select '{f}' as name, round(\"m_{f}\",6) as mean, round(\"s_{f}\",6) as deviation from fitted" for f in NUMERIC_FEATURES
        ),
    ),
    "prep_scale": with_(
        *PREP, body='select "CustomerId", ' + ", ".join(f'{scaled(f)} as "{f}"' for f in NUMERIC_FEATURES) + " from filled, fitted"
    ),
    "prep_onehot_fit": with_(BASE, SCORED, SPLIT, TRAIN, LEVELS, body="select * from placed"),
    "prep_onehot": with_(
        BASE,
        """strange as (select "CustomerId", "Gender", case when "CustomerId" % 50 = 0 then 'ATLANTIS' when "CustomerId" % 51 <> 0 then "Geography" end as g
  from base)""",
        body='select "CustomerId", '
        + ", ".join(f"case when g = '{g}' then 1e0 else 0e0 end as \"Geography_{g}\"" for g in GEOGRAPHIES)
        + ", "
        + ", ".join(f"case when \"Gender\" = '{g}' then 1e0 else 0e0 end as \"Gender_{g}\"" for g in SEGMENTS)
        + " from strange",
    ),
    "prep_assemble": with_(
        *PREP,
        LEVELS,
        body=" union all ".join(
            f'select "CustomerId", {i} as position, {scaled(f)} as value from filled, fitted' for i, f in enumerate(NUMERIC_FEATURES)
        )
        + """ union all select "CustomerId", 8 + position, case when level = "Geography" then 1e0 else 0e0 end from filled, placed where feature = 'Geography'
 union all select "CustomerId", cast(8 + (select count(*) from placed where feature = 'Geography') + position as integer),
  case when level = "Gender" then 1e0 else 0e0 end from filled, placed where feature = 'Gender'""",
    ),
    "prep_class_weights": with_(
        BASE,
        SCORED,
        body="""select "Churned", count(*) as n_class, round((select count(*) from scored)/(2e0*count(*)),6) as weight from scored group by 1""",
    ),
    # Model choice on the fixed linear models
    "model_leaderboard": with_(BASE, SCORED, LINEAR, BOARD, body="select * from board"),
    "model_select": with_(
        BASE, SCORED, LINEAR, BOARD, body="select *, roc_auc >= 0.6e0 as accepted from board order by roc_auc desc, position limit 1"
    ),
    # Scoring
    "score_linear": with_(BASE, SCORED, body='select "CustomerId", p_churn from scored'),
    "score_label": with_(
        BASE, SCORED, body='select "CustomerId", p_churn, case when p_churn >= 0.5e0 then 1 else 0 end as predicted_label from scored'
    ),
    "score_batch": with_(
        *RECORD_VIEWS,
        VALID_SCORED,
        body="""select "index", id, predicted_label, p_churn, round(clv,6) as clv, recommended_action, round(net_gain,6) as net_gain,
 recommended_action <> 'No action' and net_gain >= 0 as candidate from batch""",
    ),
    "score_stream": with_(
        *RECORD_VIEWS,
        VALID_SCORED,
        body="""select "index", id, predicted_label, p_churn, round(clv,6) as clv, recommended_action, round(net_gain,6) as net_gain from batch""",
    ),
    "score_stream_errors": with_(BASE, RAW, PROBLEMS, body="select * from problems"),
    "score_stream_summary": with_(
        *RECORD_VIEWS,
        body="""select 'partial' as mode, 'partial' as status, (select count(*) from raw_records) as total_records, (select count(*) from valid) as valid_records,
 (select count(distinct row_index) from problems) as invalid_records, (select count(*) from problems) as error_count""",
    ),
    # Metrics
    "met_confusion": with_(BASE, SCORED, CONFUSION, body="select * from confusion"),
    "met_accuracy": with_(BASE, SCORED, CONFUSION, body=f"select {rates('accuracy')} from confusion"),
    "met_precision_recall_f1": with_(BASE, SCORED, CONFUSION, body=f"select {rates('precision', 'recall', 'f1')} from confusion"),
    "met_balanced_accuracy": with_(BASE, SCORED, CONFUSION, body=f"select {rates('balanced_accuracy')} from confusion"),
    "met_roc_auc": with_(BASE, SCORED, HIST, body=f"select round({AUC},6) as roc_auc from run"),
    "met_average_precision": with_(BASE, SCORED, HIST, body=f"select round({AP},6) as pr_auc from run"),
    "met_resolve_k": """select c_mktsegment as segment, count(*) as n_rows, cast(greatest(1, ceil(count(*)*0.01e0)) as bigint) as k01,
 cast(ceil(count(*)*0.3e0) as bigint) as k30, count(*) as k100, cast(7 as bigint) as seven from customer group by 1""",
    "met_at_k": lift_sql("p_churn", "(0.1e0,'share'),(1e0,'share'),(1e0,'count'),(25e0,'count')"),
    "met_lift_curve": lift_sql("p_churn", SHARES),
    "met_lift_ties": lift_sql("round(p_churn,1)", SHARES),
    "met_report": with_(
        BASE,
        SCORED,
        CONFUSION,
        HIST,
        """ranked as (select "Churned" as y, row_number() over (order by p_churn desc, "CustomerId") as r, count(*) over () as n,
  sum("Churned") over () as p from scored)""",
        body="select confusion.*, "
        + rates(*RATES)
        + f", (select round({AUC},6) from run) as roc_auc, (select round({AP},6) from run) as pr_auc, "
        + ", ".join(
            f"""(select round((sum(case when r <= greatest(1,ceil(n*{k}e0)) then y else 0 end)/max(greatest(1,ceil(n*{k}e0))))
  /(max(p)/cast(max(n) as double)),6) from ranked) as lift_{i}"""
            for i, k in enumerate((0.01, 0.05, 0.1, 0.2, 0.3))
        )
        + " from confusion",
    ),
    "met_by_group": with_(
        BASE,
        SCORED,
        'hist as (select "Geography" as g, p_churn as s, count(*) as n, sum("Churned") as pos from scored group by 1, 2)',
        """run as (select hist.*, sum(n) over w as cn, sum(pos) over w as cp, sum(n) over (partition by g) as tn, sum(pos) over (partition by g) as tp
  from hist window w as (partition by g order by s desc rows unbounded preceding))""",
        f"ranking as (select g, {AUC} as roc_auc, {AP} as pr_auc from run group by g)",
        """cells as (select g, sum(case when s<0.5e0 then n-pos else 0 end)::bigint as tn, sum(case when s>=0.5e0 then n-pos else 0 end)::bigint as fp,
  sum(case when s<0.5e0 then pos else 0 end)::bigint as fn, sum(case when s>=0.5e0 then pos else 0 end)::bigint as tp from hist group by g)""",
        body=f"""select g as "Geography", tn, fp, fn, tp, {rates(*RATES)}, round(roc_auc,6) as roc_auc, round(pr_auc,6) as pr_auc
from cells join ranking using (g)""",
    ),
    # Decisions
    "dec_clv": with_(
        BASE,
        body="""select "CustomerId", round(greatest(0e0, case when "CustomerId" % 9 = 0 then 0e0 else "Balance" end)
 * (1e0 + greatest(0e0, case when "CustomerId" % 8 = 0 then 0e0 when "CustomerId" % 7 = 0 then -"Tenure" else "Tenure" end)/10e0)
 + 0.05e0*greatest(0e0, coalesce("EstimatedSalary",0e0)),6) as clv from base""",
    ),
    "dec_action": with_(
        *RESULT_VIEWS,
        "unit as (select \"index\", case when p between 0 and 1 then p end as p_churn from clean)",
        body=f'select "index", p_churn as p, {ACTION} as action from unit',
    ),
    "dec_action_cost": with_(*RESULT_VIEWS, body=f'select "index", recommended_action, {COST} as action_cost from results'),
    "dec_net_gain": with_(BASE, SCORED, DECIDED, body='select "CustomerId", round(net_gain,6) as net_gain from decided'),
    "dec_results": with_(
        BASE,
        SCORED,
        DECIDED,
        body="""select "CustomerId", case when "CustomerId" % 10 <> 3 then p_churn end as p_churn, round(clv,6) as clv,
 case when "CustomerId" % 10 <> 3 then recommended_action end as recommended_action,
 case when "CustomerId" % 10 <> 3 then round(net_gain,6) end as net_gain from decided""",
    ),
    # Selection
    "sel_email_candidates": with_(
        *RESULT_VIEWS,
        body="""select r."index", r.id, r.p_churn, r.recommended_action, round(r.net_gain,6) as net_gain from results r join clean c using ("index")
where c.p is not null and r.recommended_action is not null and r.recommended_action <> 'No action' and r.net_gain >= 0""",
    ),
    "sel_email_candidates_capped": with_(
        *RESULT_VIEWS,
        body="""select r."index", r.id, r.p_churn, r.recommended_action, round(r.net_gain,6) as net_gain from results r join clean c using ("index")
where c.p >= 0.35e0 and r.recommended_action = 'Retention email' and r.net_gain >= 100 order by r."index" limit 40""",
    ),
    "sel_recipients": with_(*RESULT_VIEWS, RAW, reach(False), best_recipients(50), body="select * from recipients"),
    "sel_recipient_errors": with_(*RESULT_VIEWS, RAW, reach(True), body=TARGET_ERRORS),
    "sel_recipient_errors_positions": with_(
        *RESULT_VIEWS,
        RAW,
        """said as (
select "index" as place, nullif(trim(id), '') as given_id, p_churn, "index" % 6 = 1 or "index" % 7 <> 2 as has_index,
 case when "index" % 6 = 1 then -"index" when "index" % 7 <> 2 then "index" end as "index" from results
where isfinite(p_churn) and p_churn between 0.65e0 and 1)""",
        body=r"""select 'targeting' as stage, case when s.customer_id is not null then m."index" else place end as row_index,
 case when s.customer_id is not null then coalesce(given_id, s.customer_id) end as id,
 case when not has_index then 'Result index is invalid and row was skipped' when s.customer_id is null then 'Result index is out of range and row was skipped'
 else 'Selected row is missing a valid ''email''' end as message
from said m left join raw_records s on s.row_index = m."index"
where s.customer_id is null or not coalesce(regexp_full_match(trim(s.email), '[^@\s]+@[^@\s]+\.[^@\s]+'), false)""",
    ),
    "sel_targets": with_(*RESULT_VIEWS, TARGETS, body="select * from targets"),
    "sel_targets_no_email": with_(
        *RESULT_VIEWS,
        body="""select row_number() over (order by round(p,1) desc, given_id is null, given_id, "index") as rank, id, "index", email, round(p,1) as p_churn
from contact where round(p,1) >= 0.3e0 order by rank limit 200""",
    ),
    "sel_targets_resort": with_(*RESULT_VIEWS, TARGETS, LISTED, body='select position, rank, id, "index" from listed'),
    "sel_metadata_merge": with_(
        *RESULT_VIEWS,
        TARGETS,
        body="""select t.rank, cast(t."index" as varchar) as meta_index, case when t."index" % 2 = 0 then coalesce(r.name, 'none') end as meta_segment,
 t.p_churn as meta_p, cast(case when t."index" % 2 = 0 then 3 else 2 end as integer) as n_entries
from targets t join results r using ("index")""",
    ),
    # Text
    "txt_email_normalize": with_(
        BASE,
        RAW,
        body=r"""select row_index, case when regexp_full_match(lower(trim(email)), '[^@\s]+@[^@\s]+\.[^@\s]+') then lower(trim(email)) end as email
from raw_records""",
    ),
    "txt_email_invalid": with_(
        BASE, RAW, body=r"""select row_index, email from raw_records where not regexp_full_match(trim(email), '[^@\s]+@[^@\s]+\.[^@\s]+')"""
    ),
    "txt_optional": with_(*RESULT_VIEWS, body='select "index", name from clean'),
    "txt_strip_html": f"select page_id, {untag('html')} as body from pages",
    "txt_sanitize_body": with_(
        DRAFTS,
        f"plain as (select draft_id, {collapse(lines(untag('body')))} as body from drafts)",
        r"cut as (select draft_id, string_split(body, E'\n') as l from plain)",
        body=rf"""select draft_id, {strip(rf"array_to_string(list_prepend(regexp_replace(l[1], '(?i)^\s*subject\s*:\s*', ''), l[2:]), E'\n')")} as body from cut""",
    ),
    "txt_drop_subject_lines": with_(
        DRAFTS,
        body=f"select draft_id, {collapse(f'list_filter({UNTAGGED_LINES}, lambda l: not {IS_SUBJECT})')} as body from drafts",
    ),
    "txt_draft_check": with_(DRAFTS, body=f"select draft_id, {PROBLEM} as problem from drafts"),
    "txt_draft_set_check": with_(
        GROUPS,
        f"judged as (select group_id, {PROBLEM} = 'ok' as fine from draft_groups)",
        body="""select group_id, count(*) as n_drafts, bool_and(fine) as all_fine, count(*) = 3 and bool_and(fine) as accepted
from judged group by 1""",
    ),
    "txt_pick_resolve": with_(GROUPS, SETS, body="select group_id, chosen from chosen"),
    "txt_selected_tone": with_(
        GROUPS,
        SETS,
        body="""select group_id, case when chosen = d1 then 'serious' when chosen = d2 then 'witty' when chosen = d3 then 'concise' else 'serious' end as tone
from chosen""",
    ),
    "txt_subject": with_(
        DRAFTS,
        f"full_lines as (select draft_id, list_filter({lines('body')}, lambda l: l <> '') as l from drafts)",
        rf"""subjects as (select draft_id, {strip(untag(rf"regexp_replace(coalesce(l[1], ''), '(?i)^\s*subject\s*:\s*', '')"))} as s from full_lines)""",
        body="select draft_id, case when s = '' then 'Example Co check-in' else s end as subject from subjects",
    ),
    "txt_html_body": with_(
        DRAFTS,
        f"bare as (select draft_id, {strip('body')} as b from drafts)",
        body="""select draft_id, case when b = '' then '' when contains(b, '<') then substr(b, strpos(b, '<'))
 else concat('<p>', replace(replace(replace(replace(replace(b, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '</p>') end as html
from bare""",
    ),
    "txt_prompt_batch": with_(
        *RESULT_VIEWS,
        TARGETS,
        LISTED,
        body="""select count(*) as recipient_count, concat('Write a retention outreach email from Retention Team at Example Co for ', count(*),
 ' recipients: ', string_agg(id, ', ' order by position), '.') as message_prompt from listed""",
    ),
    "txt_prompt_row": with_(
        *RESULT_VIEWS,
        body="""select "index", concat('Write a witty retention outreach email from Retention Team at Example Co to customer ', id, ' (', email,
 '). Customer churn probability is ', printf('%.2f', p), '. Do not mention scoring. Include one clear next step.') as prompt
from contact where p between 0 and 1 and email is not null""",
    ),
    "txt_context_block": with_(
        *RESULT_VIEWS,
        body=r"""select "index", concat(E'Write to them.\n\nContext:\ncompany_name: Example Co',
 case when "index" % 3 <> 0 and name is not null then concat(E'\nname: ', name) else '' end,
 case when "index" % 3 <> 0 and action is not null then concat(E'\naction: ', action) else '' end) as prompt from clean""",
    ),
    "txt_picker_prompt": with_(
        *RESULT_VIEWS,
        body=r"""select "index", concat(E'Pick the strongest draft for cold sales/retention outreach.
Return exactly one full draft body from the options below with no extra text.\n\nDraft 1:\nFirst draft.\n\nDraft 2:\nSecond draft ', "index",
 E'\n\nDraft 3:\nThird draft.', case when name is not null or action is not null or "index" % 4 = 0 then E'\n\nContext:\n' else '' end,
 concat_ws(E'\n', case when name is not null then concat('name: ', case when "index" % 4 = 0 then 'again' else name end) end,
 case when action is not null then concat('action: ', action) end, case when name is null and "index" % 4 = 0 then 'name: again' end)) as prompt from clean""",
    ),
    # Outreach and reports
    "out_recipients": with_(*RESULT_VIEWS, body='select "index", id, email, name, email is null as skipped from contact'),
    "out_payload": with_(
        *RESULT_VIEWS,
        """targets as (
select row_number() over (order by p desc, given_id is null, given_id, "index") as rank, id, "index", email, name
from contact where p >= 0.6e0 order by rank limit 50)""",
        LISTED,
        body="""select 'Example Co' as company_name, 'Retention Team' as from_name,
 (select concat('Write a retention outreach email from Retention Team at Example Co for ', count(*), ' recipients: ',
   string_agg(id, ', ' order by position), '.') from listed) as message_prompt,
 'retention@example.com' as from_email, 'friendly-and-direct' as tone_policy, 'dry_run' as send_mode,
 cast(row_number() over (order by position) - 1 as integer) as place, id, email, name, cast("index" as varchar) as meta_index
from listed where email is not null""",
    ),
    "out_outbox": with_(
        *RESULT_VIEWS,
        RAW,
        reach(False),
        best_recipients(50),
        DRAFTED,
        body=r"""select id, email, concat('{"from":{"email":"retention@example.com"},"personalizations":[{"to":[{"email":"', email,
 '"}]}],"subject":"', first_line, '","content":[{"type":"text/html","value":"<p>', replace(body_text, E'\n', '\n'), '</p>"}]}') as message
from drafted where body_text is not null""",
    ),
    "out_draft_rows": with_(
        *RESULT_VIEWS,
        RAW,
        reach(False),
        best_recipients(50),
        DRAFTED,
        body=f"""select id, email, rank, first_line as subject, body_text, null::varchar as stage, null::varchar as message from drafted where body_text is not null
union all select id, email, null, null, null, 'draft', {DRAFT_ERROR} from drafted where body_text is null""",
    ),
    "rep_errors_union": with_(
        *RESULT_VIEWS,
        RAW,
        PROBLEMS,
        LOG,
        "first as (select * from (" + with_(reach(True), body=TARGET_ERRORS) + "))",
        "second as (select * from (" + with_(reach(False), best_recipients(50), DRAFTED, body="select id, email from drafted where body_text is null") + "))",
        body=f"""select 'batch_validation' as stage, row_index, id, field, message, null::varchar as email from problems
union all select stage, row_index, id, null, message, null from first
union all select 'draft', null, id, null, {DRAFT_ERROR}, email from second
union all select 'send', null, cast(id as varchar), null, {FAILED}, null from outcomes where not sent_ok""",
    ),
    "rep_send_outcome": with_(LOG, body="select id, sent_ok from outcomes"),
    "rep_send_status": with_(LOG, body="select id, send_status from outcomes"),
    "rep_send_summary": with_(
        LOG, body="select count(*) as attempted, count(*) filter (sent_ok) as sent, count(*) filter (not sent_ok) as failed from outcomes"
    ),
    "rep_outreach_summary": with_(
        *RECORD_VIEWS,
        VALID_SCORED,
        body="""select (select count(*) from raw_records) as n_records, (select count(*) from valid) as n_valid,
 (select count(distinct row_index) from problems) as n_invalid,
 (select least(20, count(*)) from batch where p_churn >= 0.65e0 and regexp_full_match(trim(email), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')) as n_selected,
 0.65e0 as threshold, 20 as max_emails, true as dry_run""",
    ),
    "rep_outreach_status": with_(
        *RECORD_VIEWS,
        body="""select "Geography", case when max(e) is null then 'ok' when count(*) filter (e is null) > 0 then 'partial' else 'error' end as status
from raw_records left join (select row_index, count(*) as e from problems group by 1) using (row_index) group by 1""",
    ),
    "rep_run_summary": with_(
        *RESULT_VIEWS,
        RUNS,
        body="""select "Geography", n as total_rows, n_usable as valid_predictions, n_selected as selected,
 case when "Geography" = 'EUROPE' then 0 else n_selected end as drafted,
 case when "Geography" > 'ASIA' and "Geography" <> 'EUROPE' then n_selected else 0 end as sent from runs""",
    ),
    "rep_run_status": with_(
        *RESULT_VIEWS,
        RUNS,
        body="""select "Geography", case when n_errors = 0 then 'ok' when n_selected > 0 then 'partial' else 'error' end as status from runs""",
    ),
    "out_from_batch": with_(
        *RESULT_VIEWS,
        """targets as (
select row_number() over (order by p desc, given_id is null, given_id, "index") as rank, id, "index", email
from contact where p >= 0.6e0 and action = 'Discount or retention call' order by rank limit 30)""",
        LISTED,
        body="""select (select count(*) from results) as total_rows, (select count(*) from clean where p is not null or action is not null) as valid_predictions,
 count(*) as selected, count(*) as drafted, cast(0 as bigint) as sent,
 case when count(*) filter (email is null) = 0 then 'ok' else 'partial' end as status, 'serious' as selected_draft,
 concat('Write a retention outreach email from Retention Team at Example Co for ', count(*), ' recipients: ',
   string_agg(id, ', ' order by position), '.') as subject, 'skipped' as send_status, count(*) filter (email is null) as n_errors
from listed""",
    ),
    "out_writer_failure": with_(
        *RESULT_VIEWS,
        """targets as (
select row_number() over (order by p desc, given_id is null, given_id, "index") as rank, id, "index", email
from contact where p >= 0.6e0 and action = 'Discount or retention call' order by rank limit 30)""",
        """asked as (select count(*) as n, count(*) filter (email is not null) as reachable, count(*) filter (email is null) as skipped from targets)""",
        """stated as (
select 'payload' as stage, 'Skipping recipient without email' as message, skipped as n from asked where skipped > 0
union all select 'request_build', 'No recipients with valid email addresses remain after payload normalization', 1 from asked where n > 0 and reachable = 0
union all select 'config', '''context'' must be a dictionary when provided', 1 from asked where reachable > 0
union all select 'config', '''metadata'' must be a dictionary when provided', 1 from asked where reachable > 0
union all select 'sales_manager', 'writer is away', 1 from asked where reachable > 0)""",
        body="""select stage, message, stated.n, case when asked.n > 0 then 'partial' else 'error' end as status, asked.n as selected,
 0 as drafted, 0 as sent, 0 as n_serious, least(reachable, 1) as n_witty, least(reachable, 1) as n_concise
from stated, asked""",
    ),
    "out_from_records": with_(
        *RECORD_VIEWS,
        VALID_SCORED,
        """high as (select regexp_full_match(trim(email), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') as reachable from batch where p_churn >= 0.65e0)""",
        """counts as (select (select count(*) from raw_records) as n_records, (select count(*) from valid) as n_valid,
  (select count(distinct row_index) from problems) as n_invalid, (select least(20, count(*)) from high where reachable) as n_selected,
  (select count(*) from problems) + (select count(*) from high where not reachable) as n_errors)""",
        body="""select *, 0.65e0 as threshold, 20 as max_emails, true as dry_run,
 case when n_errors = 0 then 'ok' when n_valid > 0 then 'partial' else 'error' end as status from counts""",
    ),
}
