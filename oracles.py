"""DuckDB SQL for every registered query, over the same Parquet tables.

Written on its own, not generated from the Spark code: joins where Spark merges, windows where it groups.
"""

from __future__ import annotations

# Frame of the dashboard (page, name): the query whose rows it has.
DASHBOARD_FRAMES = {
    "audit": "audit",
    "audit_warnings": "audit_warnings",
    "stage_list": "stage_list",
    "overview_kpis": "overview_kpis",
    "overview_primary_bottleneck": "primary_bottleneck",
    "onboarding_kpis": "onboarding_kpis",
    "onboarding_stage_summary": "stage_summary",
    "onboarding_stage_status": "stage_status_long",
    "tools_kpis": "tool_kpis",
    "tools_tool_summary": "tool_summary",
    "tools_support_overlap": "tool_support_overlap",
    "support_kpis": "support_kpis",
    "support_category_summary": "support_category_summary",
    "support_timeline": "support_timeline",
    "support_repeated_issues": "repeated_issues",
    "friction_points": "friction_points",
    "friction_evidence": "friction_evidence",
    "friction_ranked": "friction_ranked",
    "journey_daily": "journey_daily",
    "journey_weekly_tickets": "journey_weekly_tickets",
}

# ---------------------------------------------------------------- tables derived from events

_EMPLOYEE = "case when event_id % 101 = 0 then null else concat('EMP-', cast(user_id as varchar(20))) end as employee_id"

_REQUESTER = _EMPLOYEE.replace("user_id", "case when user_id % 4 = 0 then user_id + 1 else user_id end")

_ONBOARDING = f"""
select {{key}}{_EMPLOYEE},
       concat('Stage-', cast(event_id % 6 + 1 as varchar(20))) as onboarding_stage,
       case when event_id % 7 in (0,1,2) then 'Completed' when event_id % 7 in (3,4) then 'Delayed'
            when event_id % 7 = 5 then 'In Progress' else 'Not Started' end as stage_status,
       cast(ts as date) as start_date,
       case when event_id % 59 = 0 then cast(cast(ts as date) - interval '2' day as date)
            when event_id % 7 in (0,1,2) or (event_id % 7 = 3 and event_id % 2 = 0)
            then cast(cast(ts as date) + (event_id % 9) * interval '1' day as date) end as completion_date
from events where event_type = 'signup'"""

_TOOL_USAGE = f"""
select {{key}}{_EMPLOYEE},
       concat('Tool-', cast(event_id % 9 + 1 as varchar(20))) as tool_name,
       ts + cast(floor(value / 10) as int) * interval '1' day as usage_date,
       concat('Activity-', cast(event_id % 6 + 1 as varchar(20))) as usage_activity,
       case when event_id % 97 = 0 then null when event_type <> 'error' then 'Success'
            when event_id % 3 = 0 then 'Failed' when event_id % 3 = 1 then 'Timeout'
            else 'Permission Denied' end as usage_status
from events {{copies}}
where event_type in ('click','view','error')"""

_SUPPORT = f"""
select concat('REQ-', cast(event_id as varchar(20))) as request_id,
       {_REQUESTER},
       concat('Category-', cast(event_id % 6 + 1 as varchar(20))) as request_category,
       ts + cast(floor(value / 10) as int) * interval '1' day as request_date,
       case when event_id % 10 = 0 then 'Pending' when event_id % 10 = 1 then 'In Progress'
            when event_id % 10 = 2 then 'Closed' else 'Resolved' end as request_status,
       case when event_id % 10 in (0,1) then null when event_id % 53 = 0 then -value else value end as resolution_time
from events {{copies}} where event_type = 'purchase'"""


def _copies(every: int) -> str:
    return f"join (select 0 as copy_no union all select 1 as copy_no) x on copy_no = 0 or event_id % {every} = 0"


def _uploads(without: str = "") -> str:
    """The uploaded tables, one of them without rows if named."""
    tables = {
        "onboarding": _ONBOARDING.format(key=""),
        "tool_usage": _TOOL_USAGE.format(key="", copies=_copies(89)),
        "support_requests": _SUPPORT.format(copies=_copies(83)),
    }
    return "\nwith " + ",\n".join(
        f"{name} as (select * from ({rows}) r where {'false' if name == without else 'true'})"
        for name, rows in tables.items()
    )


UPLOADS = _uploads()

DATABASE = f"""
with onboarding as ({_ONBOARDING.format(key="event_id as onboarding_id, ")}),
tool_usage as ({_TOOL_USAGE.format(key="event_id as usage_id, ", copies="")}),
support_requests as ({_SUPPORT.format(copies="")}),
start_dates as (select employee_id, min(start_date) as joining_date from onboarding group by employee_id)"""

# ---------------------------------------------------------------- the cleaned first month

_CLEAN = """,
dedup_onb as (select distinct * from onboarding),
dedup_tool as (select distinct * from tool_usage),
dedup_sup as (select distinct * from support_requests),
day_zero as (
  select employee_id, min(d) as joining_date from (
    select employee_id, start_date as d from dedup_onb
    union all select employee_id, cast(usage_date as date) from dedup_tool
    union all select employee_id, cast(request_date as date) from dedup_sup) c
  where employee_id is not null and d is not null group by employee_id),
onb as (
  select o.*, z.joining_date, cast(o.start_date - z.joining_date as integer) as days_since_joining,
         cast(o.completion_date - o.start_date as integer) as duration_days
  from dedup_onb o join day_zero z on o.employee_id = z.employee_id
  where o.start_date - z.joining_date between 0 and 30),
tool as (
  select t.*, z.joining_date, cast(cast(t.usage_date as date) - z.joining_date as integer) as days_since_joining
  from dedup_tool t join day_zero z on t.employee_id = z.employee_id
  where cast(t.usage_date as date) - z.joining_date between 0 and 30),
sup as (
  select s.* replace (greatest(coalesce(case when isnan(s.resolution_time) then null else s.resolution_time end, 0.0), 0.0)
                      as resolution_time),
         z.joining_date, cast(cast(s.request_date as date) - z.joining_date as integer) as days_since_joining
  from dedup_sup s join day_zero z on s.employee_id = z.employee_id
  where cast(s.request_date as date) - z.joining_date between 0 and 30)"""

CLEANED = UPLOADS + _CLEAN

_COHORT = """,
cohort as (select distinct employee_id from onb where onboarding_stage = 'Stage-3'),
onb_c as (select * from onb where employee_id in (select employee_id from cohort)),
tool_c as (select * from tool where employee_id in (select employee_id from cohort)),
sup_c as (select * from sup where employee_id in (select employee_id from cohort))"""


def _scaled(x: str, digits: int) -> str:
    return f"round_even(({x}) * {10**digits}, 0) / {10**digits}.0"


def _exact(x: str, digits: int) -> str:
    """Correctly rounded decimal text of the exact binary value, read back."""
    return f"cast(format('{{:.{digits}f}}', cast({x} as double)) as double)"


_STAGES = f""",
stages as (
  select onboarding_stage, count(*) as total_assigned,
         count(*) filter (where stage_status = 'Completed') as completed_count,
         count(*) filter (where stage_status = 'Delayed') as delayed_count,
         count(*) filter (where stage_status = 'In Progress') as in_progress_count,
         coalesce({_scaled("avg(duration_days)", 2)}, 0.0) as avg_duration_days
  from onb group by onboarding_stage)"""

_TOOLS = """,
tools as (
  select tool_name, count(*) as total_usage_events, count(distinct employee_id) as active_users,
         count(*) filter (where usage_status = 'Success') as successful_events,
         count(*) filter (where usage_status is distinct from 'Success') as failed_events
  from tool group by tool_name)"""

_CATEGORIES = f""",
categories as (
  select request_category, count(*) as total_requests,
         count(*) filter (where request_status is distinct from 'Resolved') as unresolved_count,
         coalesce({_scaled("avg(resolution_time)", 2)}, 0.0) as avg_resolution_hours
  from sup group by request_category)"""

_ONBOARDING_KPIS = f"""
select (select count(distinct employee_id) from onb) as total_employees,
       coalesce((select {_exact("count(*) filter (where stage_status = 'Completed') / nullif(count(*), 0) * 100", 2)}
                 from onb), 0.0) as overall_completion_rate,
       coalesce((select onboarding_stage from stages
                 order by delayed_count desc, avg_duration_days desc, onboarding_stage limit 1), 'None') as top_delayed_stage,
       coalesce((select onboarding_stage from stages
                 order by avg_duration_days desc, onboarding_stage limit 1), 'None') as top_longest_stage,
       coalesce((select {_scaled("sum(cast(round_even(avg_duration_days * 100, 0) as bigint)) / 100.0", 1)}
                 from stages), 0.0) as avg_onboarding_time_days"""

_SUPPORT_KPIS = f"""
select (select count(*) from sup) as total_requests,
       (select count(*) from sup where request_status is distinct from 'Resolved') as unresolved_requests,
       coalesce((select {_exact("avg(resolution_time)", 2)} from sup), 0.0) as avg_resolution_hrs,
       coalesce((select request_category from categories
                 order by total_requests desc, request_category limit 1), 'None') as most_common_category,
       coalesce((select request_category from categories
                 order by avg_resolution_hours desc, request_category limit 1), 'None') as slowest_category"""

_TOOL_KPIS = """
select coalesce((select tool_name from tools order by total_usage_events desc, tool_name limit 1), 'None') as most_used_tool,
       coalesce((select tool_name from tools order by total_usage_events, tool_name desc limit 1), 'None') as least_used_tool,
       coalesce((select tool_name from tools order by failed_events desc, tool_name limit 1), 'None') as most_problematic_tool"""


# The sentences and labels below are part of the result.
def _friction(onb: str = "onb", tool: str = "tool", sup: str = "sup") -> str:
    return f""",
cohort_size as (select greatest(1, count(distinct employee_id)) as n from {onb}),
groups as (
  select 'Onboarding Stage Delay: ' as label, 'Onboarding Progress' as source, onboarding_stage as name,
         count(*) as frequency, count(distinct employee_id) as affected_employees,
         {_exact("coalesce(avg(duration_days), 4.0)", 1)} as m, 5.0 as divisor, 10.0 as weight
  from {onb} where stage_status = 'Delayed' group by onboarding_stage
  union all
  select 'Tool Usage Failure: ', 'Internal Tool Usage', f.tool_name, f.frequency, f.affected_employees,
         {_exact("f.frequency / a.total * 100", 1)}, 20.0, 8.0
  from (select tool_name, count(*) as frequency, count(distinct employee_id) as affected_employees
        from {tool} where usage_status is distinct from 'Success' group by tool_name) f
  join (select tool_name, count(*) as total from {tool} group by tool_name) a on a.tool_name = f.tool_name
  union all
  select 'Support Dependency: ', 'Support Requests', request_category, count(*), count(distinct employee_id),
         {_exact("coalesce(avg(resolution_time), 8.0)", 1)}, 12.0, 9.0
  from {sup} group by request_category),
scored as (
  select *, {_exact("affected_employees / n * 100", 1)} as affected_pct,
         format('{{:.1f}}', m) as m_text
  from groups cross join cohort_size),
friction as (
  select concat(label, name) as friction_point, source, frequency, affected_employees, affected_pct,
         concat(m_text, case source when 'Onboarding Progress' then ' days average completion time'
                                    when 'Internal Tool Usage' then '% usage error rate'
                                    else ' hours MTTR resolution time' end) as impact_metric,
         {_exact("frequency * (affected_employees / n) * (1 + m / cast(divisor as double)) * cast(weight as double)", 1)}
           as friction_score,
         case source
           when 'Onboarding Progress' then concat(frequency, ' delayed stage assignments affecting ',
                                                  format('{{:.1f}}', affected_pct), '% of new hires.')
           when 'Internal Tool Usage' then concat(frequency, ' failed/timeout access events across ',
                                                  format('{{:.1f}}', affected_pct), '% of new hires.')
           else concat(frequency, ' helpdesk requests logged with average resolution time of ', m_text, ' hrs.')
         end as evidence,
         case source
           when 'Onboarding Progress' then
             'Slows down progression to subsequent onboarding milestones and initial team contribution.'
           when 'Internal Tool Usage' then
             'Blocks daily operational workflows and creates login/authentication downtime.'
           else 'Indicates IT access barriers that halt work until helpdesk tickets are resolved.'
         end as productivity_impact
  from scored)"""


def _duplicates(table: str) -> str:
    return f"((select count(*) from {table}) - (select count(*) from (select distinct * from {table})))"


def _missing(table: str) -> str:
    return f"(select count(*) from {table} where employee_id is null)"


def _checks() -> dict[str, dict[str, str]]:
    return {
        "onboarding": {
            "employee_id_not_null": "employee_id is null",
            "onboarding_stage_not_null": "onboarding_stage is null",
            "stage_status_not_null": "stage_status is null",
            "start_date_not_null": "start_date is null",
            "employee_id_max_length": "length(employee_id) > 50",
            "onboarding_stage_max_length": "length(onboarding_stage) > 100",
            "stage_status_max_length": "length(stage_status) > 50",
            "stage_status_domain": "stage_status not in ('Completed', 'In Progress', 'Delayed', 'Not Started')",
            "completion_not_before_start": "completion_date < start_date",
        },
        "tool_usage": {
            "employee_id_not_null": "employee_id is null",
            "tool_name_not_null": "tool_name is null",
            "usage_date_not_null": "usage_date is null",
            "usage_activity_not_null": "usage_activity is null",
            "employee_id_max_length": "length(employee_id) > 50",
            "tool_name_max_length": "length(tool_name) > 100",
            "usage_activity_max_length": "length(usage_activity) > 100",
            "usage_status_max_length": "length(usage_status) > 50",
            "usage_status_domain": "usage_status not in ('Success', 'Failed', 'Timeout', 'Permission Denied')",
        },
        "support_requests": {
            "request_id_not_null": "request_id is null",
            "employee_id_not_null": "employee_id is null",
            "request_category_not_null": "request_category is null",
            "request_date_not_null": "request_date is null",
            "request_status_not_null": "request_status is null",
            "request_id_max_length": "length(request_id) > 50",
            "employee_id_max_length": "length(employee_id) > 50",
            "request_category_max_length": "length(request_category) > 100",
            "request_status_max_length": "length(request_status) > 50",
            "request_status_domain": "request_status not in ('Resolved', 'Pending', 'In Progress', 'Closed')",
            "resolution_time_not_negative": "resolution_time < 0",
        },
    }


def _violations() -> str:
    selects = [
        f"select '{table}' as table_name, '{rule}' as rule, (select count(*) from {table} where {broken}) as violations"
        for table, rules in _checks().items()
        for rule, broken in rules.items()
    ]
    selects.append(
        "select 'support_requests', 'request_id_unique',"
        " (select count(request_id) - count(distinct request_id) from support_requests)"
    )
    return UPLOADS + "\n" + "\nunion all ".join(selects)


def _sql_mean(total: str, n: str) -> str:
    return f"case when {n} > 0 then sign({total}) * ((200 * abs({total}) + {n}) // (2 * {n})) / 100.0 end"


def _rejected(table: str) -> str:
    names = ", ".join(f"case when {broken} then '{rule}' end" for rule, broken in _checks()[table].items())
    return f"{UPLOADS} select * from (select *, concat_ws(',', {names}) as broken_rules from {table}) r where broken_rules <> ''"


# What absent columns are filled with.
_DEFAULTS = {
    "onboarding": "cast(null as date) as completion_date, 'In Progress' as stage_status",
    "tool_usage": "'Success' as usage_status, 'General Activity' as usage_activity",
    "support_requests": "cast(null as double) as resolution_time, 'Pending' as request_status",
}

# Columns an upload must have.
_REQUIRED = {
    "onboarding": ["employee_id", "onboarding_stage", "start_date"],
    "tool_usage": ["employee_id", "tool_name", "usage_date"],
    "support_requests": ["employee_id", "request_category", "request_date"],
}

#: Tool rows stored a second time under other keys.
_STORED_AGAIN = f"""{DATABASE},
stored as (select * from tool_usage
           union all select * replace (-1 - usage_id as usage_id) from tool_usage where usage_id % 89 = 0)"""


_KEYED = {
    "onboarding": ("onboarding_id", "employee_id, onboarding_stage, stage_status, start_date, completion_date"),
    "tool_usage": ("usage_id", "employee_id, tool_name, usage_date, usage_activity, usage_status"),
    "support_requests": ("request_id", "employee_id, request_category, request_date, request_status, resolution_time"),
}


def _enforced(table: str) -> str:
    """What two appends store and refuse. ``batch`` 0: stored."""
    key, others = _KEYED[table]
    order = ", ".join(f"{name} nulls first" for name in others.split(", "))
    names = ", ".join(f"case when {broken} then '{rule}' end" for rule, broken in _checks()[table].items())
    number = f"cast(regexp_extract(cast({key} as varchar), '[0-9]+') as bigint)"

    def judged(batch: str, known: str) -> str:
        return f"""
select *, case when rules <> '' then rules when {key} in (select {key} from {known}) or n > 1 then '{key}_unique' else '' end as verdict
from (select *, row_number() over (partition by {key}, rules order by {order}) as n
      from (select *, concat_ws(',', {names}) as rules from {batch}))"""

    refused = "select * exclude (rules, n, verdict), verdict as broken_rules, count(*) as copies, {i} as batch from judged{i} where verdict <> '' group by all"
    return f"""{DATABASE},
batch1 as (select * from {table} where {number} % 2 = 0 union all select * from {table} where {number} % 14 = 0
           union all select * replace ('EMP-0' as employee_id) from {table} where {number} % 14 = 0),
nothing as (select {key} from {table} where false),
judged1 as materialized ({judged("batch1", "nothing")}),
stored1 as (select * exclude (rules, n, verdict) from judged1 where verdict = ''),
judged2 as materialized ({judged(table, "stored1")}),
stored2 as (select * from stored1 union all select * exclude (rules, n, verdict) from judged2 where verdict = '')
select *, '' as broken_rules, 1::bigint as copies, 0 as batch from stored2
union all {refused.format(i=1)} union all {refused.format(i=2)}"""


def oracle_sql() -> dict[str, str]:
    tables = ["onboarding", "tool_usage", "support_requests"]
    sql = {}
    for table in tables:
        sql[f"load_{table}"] = f"{UPLOADS} select * from {table}"
        sql[f"load_defaults_{table}"] = f"{UPLOADS} select * replace ({_DEFAULTS[table]}) from {table}"
        sql[f"rejected_{table}"] = _rejected(table)
        sql[f"dedup_{table}"] = f"{UPLOADS} select distinct * from {table}"
        sql[f"csv_import_{table}"] = f"{UPLOADS} select * from {table}"
    for table in tables:
        sql[f"append_enforced_{table}"] = _enforced(table)
    sql["append_dedup_tool_usage"] = f"""{DATABASE},
batches as (select 1 as batch, * from tool_usage where usage_id % 3 > 0
            union all select 1, * replace (-1 - usage_id as usage_id) from tool_usage where usage_id % 89 = 0
            union all select 2, * from tool_usage)
select * exclude (batch) from batches
qualify row_number() over (
  partition by employee_id, tool_name, usage_date, usage_activity, usage_status order by batch, usage_id) = 1"""
    sql["day_zero_incremental"] = f"{CLEANED} select employee_id, joining_date from day_zero"
    sql["clean_tool_usage_kept_day_zero"] = f"{CLEANED} select * from tool"
    for name, cleaned in (("onboarding", "onb"), ("tool_usage", "tool"), ("support_requests", "sup")):
        sql[f"clean_{name}_bucketed"] = f"{CLEANED} select * from {cleaned}"
    sql["csv_import_onboarding_other_dates"] = f"{UPLOADS} select * from onboarding"
    sql["upload_refusals"] = f"{UPLOADS}\n" + " union all ".join(
        [
            f"""select '{t}' as table_name, 'no rows' as upload, 'The upload for {t} has no rows.' as message
union all select '{t}', 'no column', 'The upload for {t} lacks [''{needed[1]}'']; it must have [''{"'', ''".join(needed)}''].'"""
            for t, needed in _REQUIRED.items()
        ]
        + [f"select 'all', 'has rows', case when {' or '.join(f'exists (select * from {t})' for t in tables)} then 'True, False' end"]
    )
    sql["append_tool_usage"] = f"""{DATABASE} select * from tool_usage union all select * from tool_usage"""
    sql["dedup_tool_usage_ignore_keys"] = f"""{_STORED_AGAIN}
select min(usage_id) as usage_id, * exclude (usage_id) from stored group by all"""
    sql["audit_ignore_keys"] = f"""{_STORED_AGAIN},
onb_rows as (select * exclude (onboarding_id) from onboarding),
tool_rows as (select * exclude (usage_id) from stored)
select cast({" + ".join(_missing(t) for t in ("onb_rows", "tool_rows", "support_requests"))} as bigint) as missing_employee_ids,
       cast({" + ".join(_duplicates(t) for t in ("onb_rows", "tool_rows", "support_requests"))} as bigint) as duplicate_records,
       (select count(*) from (select distinct * from onb_rows) where completion_date < start_date) as invalid_timestamps,
       (select count(*) from (select distinct * from support_requests) where resolution_time < 0)
         as negative_resolution_times"""
    sql["clear_tables"] = f"{DATABASE}\n" + " union all ".join(
        f"select '{table}' as table_name, count(*) as n_before, 0::bigint as n_after from {table}" for table in tables
    )
    sql["custom_query"] = (
        f"{UPLOADS} select tool_name, count(*) as n from tool_usage where usage_status = 'Failed' group by tool_name"
    )
    sql["trim_strings"] = f"{UPLOADS} select * from tool_usage"
    sql["audit"] = f"""{UPLOADS}
select cast({" + ".join(_missing(t) for t in tables)} as bigint) as missing_employee_ids,
       cast({" + ".join(_duplicates(t) for t in tables)} as bigint) as duplicate_records,
       (select count(*) from (select distinct * from onboarding) where completion_date < start_date) as invalid_timestamps,
       (select count(*) from (select distinct * from support_requests) where resolution_time < 0)
         as negative_resolution_times"""
    sql["audit_warnings"] = f"""{UPLOADS},
counts as ({" union all ".join(
        f"select '{t}' as table_name, {_missing(t)} as missing, {_duplicates(t)} as duplicates" for t in tables)})
select table_name, concat('Found ', missing, ' missing employee_ids in table ''', table_name, '''.') as warning
from counts where missing > 0
union all
select table_name, concat('Deduplicated ', duplicates, ' duplicate records from ''', table_name, '''.')
from counts where duplicates > 0"""
    sql["constraint_violations"] = _violations()
    sql["day_zero"] = f"{CLEANED} select employee_id, joining_date from day_zero"
    sql["clean_onboarding"] = f"{CLEANED} select * from onb"
    sql["clean_tool_usage"] = f"{CLEANED} select * from tool"
    sql["clean_support_requests"] = f"{CLEANED} select * from sup"
    sql["stage_list"] = f"{CLEANED} select distinct onboarding_stage from onb where onboarding_stage is not null"

    sql["view_employee_start_dates"] = f"{DATABASE} select * from start_dates"
    sql["view_first_30_days_onboarding"] = f"""{DATABASE}
select * from (
  select *, cast(date_diff('day', joining_date, start_date) as integer) as start_day_offset,
         cast(date_diff('day', start_date, completion_date) as integer) as stage_duration_days
  from onboarding join start_dates using (employee_id)) v
where start_day_offset between 0 and 30"""
    sql["view_first_30_days_tool_usage"] = f"""{DATABASE}
select *, cast(floor(epoch(usage_date - joining_date) / 86400) as integer) as days_since_joining
from tool_usage join start_dates using (employee_id)
where epoch(usage_date - joining_date) between 0 and 30 * 86400"""
    sql["view_first_30_days_support"] = f"""{DATABASE}
select *, cast(floor(epoch(request_date - joining_date) / 86400) as integer) as days_since_joining
from support_requests join start_dates using (employee_id)
where epoch(request_date - joining_date) between 0 and 30 * 86400"""
    sql["view_sql"] = f"""{DATABASE}
select tool_name, count(*) as events, count(distinct employee_id) as employees
from tool_usage join start_dates using (employee_id)
where epoch(usage_date - joining_date) between 0 and 30 * 86400 and usage_status = 'Timeout'
group by tool_name"""
    sql["sql_stage_delays"] = f"""{UPLOADS}
select onboarding_stage, count(*) as total_assignments,
       count(*) filter (where stage_status = 'Completed') as completed_count,
       count(*) filter (where stage_status = 'Delayed') as delayed_count,
       {_sql_mean("cast(sum(completion_date - start_date) as bigint)", "count(completion_date - start_date)")}
         as avg_duration_days
from onboarding group by onboarding_stage"""
    sql["sql_tool_failures"] = f"""{UPLOADS}
select tool_name, count(*) as total_usage_events,
       count(*) filter (where usage_status <> 'Success') as failed_usage_events,
       ((20000 * count(*) filter (where usage_status <> 'Success') + count(*)) // (2 * count(*))) / 100.0 as failure_rate_pct
from tool_usage group by tool_name"""
    sql["sql_support_mttr"] = f"""{UPLOADS}
select request_category, count(*) as total_requests,
       count(*) filter (where request_status <> 'Resolved') as unresolved_requests,
       floor(avg(resolution_time) * 100 + 0.5) / 100 as avg_resolution_hours
from support_requests group by request_category"""

    sql["stage_summary"] = f"""{CLEANED}{_STAGES}
select *, {_scaled("delayed_count / total_assigned * 100", 2)} as delay_rate_pct,
       {_scaled("completed_count / total_assigned * 100", 2)} as completion_rate_pct
from stages"""
    sql["stage_status_long"] = f"""{CLEANED}{_STAGES}
select onboarding_stage, 'completed_count' as status_type, completed_count as "count" from stages
union all select onboarding_stage, 'delayed_count', delayed_count from stages
union all select onboarding_stage, 'in_progress_count', in_progress_count from stages"""
    sql["onboarding_kpis"] = f"{CLEANED}{_STAGES}{_ONBOARDING_KPIS}"
    sql["tool_summary"] = f"""{CLEANED}{_TOOLS}
select *, {_scaled("failed_events / total_usage_events * 100", 2)} as failure_rate_pct from tools"""
    sql["tool_kpis"] = f"{CLEANED}{_TOOLS}{_TOOL_KPIS}"
    sql["tool_support_overlap"] = f"""{CLEANED}
select tool_name, count(*) as events_by_supported_employees,
       count(*) filter (where usage_status is distinct from 'Success') as failed_events
from tool where employee_id in (select employee_id from sup) group by tool_name"""
    sql["support_category_summary"] = f"{CLEANED}{_CATEGORIES} select * from categories"
    sql["support_kpis"] = f"{CLEANED}{_CATEGORIES}{_SUPPORT_KPIS}"
    sql["support_timeline"] = f"""{CLEANED}
select days_since_joining, request_category, count(*) as request_count
from sup group by days_since_joining, request_category"""
    sql["repeated_issues"] = f"""{CLEANED}
select cast(coalesce(sum(n - 1), 0) as bigint) as repeated_issues_count
from (select count(*) as n from sup group by employee_id, request_category) c where n > 1"""

    points = CLEANED + _friction()
    sql["friction_points"] = f"{points} select * from friction"
    sql["friction_evidence"] = (
        f"{points} select friction_point, frequency, affected_pct, impact_metric, friction_score from friction"
    )
    sql["friction_ranked"] = f"""{points}
select cast(row_number() over (order by friction_score desc, friction_point) as integer) as rank, * from friction"""
    sql["primary_bottleneck"] = f"""{points}
select friction_point, affected_pct, affected_employees, evidence, productivity_impact
from friction order by friction_score desc, friction_point limit 1"""
    sql["cohort_friction"] = f"{CLEANED}{_COHORT}{_friction('onb_c', 'tool_c', 'sup_c')} select * from friction"
    sql["journey_daily"] = f"""{CLEANED}
select cast(d as integer) as days_since_joining,
       (select count(*) from onb where days_since_joining = d) as onboarding_events,
       (select count(*) from tool where days_since_joining = d) as tool_events,
       (select count(*) from sup where days_since_joining = d) as support_tickets
from range(0, 31) r(d)"""
    sql["journey_weekly_tickets"] = f"""{CLEANED},
weeks(week, day_from, day_to) as (values (1, 0, 7), (2, 8, 14), (3, 15, 21), (4, 22, 30))
select week, day_from, day_to, count(sup.employee_id) as support_tickets
from weeks left join sup on sup.days_since_joining between day_from and day_to group by week, day_from, day_to"""
    overview = f"""{_STAGES}{_TOOLS}{_CATEGORIES}
select k.total_employees as total_hires, k.overall_completion_rate as completion_rate,
       k.avg_onboarding_time_days as avg_completion_days, s.total_requests as total_support_requests,
       case when s.total_requests > 0 then s.most_common_category else 'N/A' end as most_common_issue,
       case when k.total_employees > 0 then k.top_delayed_stage else 'N/A' end as top_delayed_stage,
       case when (select count(*) from tool) > 0 then t.most_problematic_tool else 'N/A' end as most_problematic_tool
from ({_ONBOARDING_KPIS}) k cross join ({_SUPPORT_KPIS}) s cross join ({_TOOL_KPIS}) t"""
    sql["overview_kpis"] = CLEANED + overview
    for frame, report in DASHBOARD_FRAMES.items():
        sql[f"dashboard_{frame}"] = sql[report]
    sql["dashboard_cohort_friction"] = sql["cohort_friction"]
    for table in tables:
        cleaned = _uploads(without=table) + _CLEAN
        sql[f"overview_kpis_no_{table}"] = cleaned + overview
        sql[f"friction_points_no_{table}"] = f"{cleaned}{_friction()} select * from friction"
        sql[f"journey_daily_no_{table}"] = sql["journey_daily"].replace(CLEANED, cleaned)
    sql["onboarding_kpis_no_onboarding"] = f"{_uploads('onboarding')}{_CLEAN}{_STAGES}{_ONBOARDING_KPIS}"
    sql["tool_kpis_no_tool_usage"] = f"{_uploads('tool_usage')}{_CLEAN}{_TOOLS}{_TOOL_KPIS}"
    sql["support_kpis_no_support_requests"] = f"{_uploads('support_requests')}{_CLEAN}{_CATEGORIES}{_SUPPORT_KPIS}"
    sql["friction_points_no_rows"] = f"""{CLEANED},
calm_onb as (select * from onb where stage_status != 'Delayed'), calm_tool as (select * from tool where usage_status = 'Success'),
calm_sup as (select * from sup where false){_friction("calm_onb", "calm_tool", "calm_sup")} select * from friction"""
    cohorts = []
    for n in range(1, 7):
        here = f"employee_id in (select employee_id from onb where onboarding_stage = 'Stage-{n}')"
        names = [f"(select * from {t} where {here})" for t in ("onb", "tool", "sup")]
        lines = _friction(*names).lstrip(",\n")
        cohorts.append(f"select 'Stage-{n}' as onboarding_stage, * from (with {lines} select * from friction) where exists {names[0]}")
    sql["cohort_friction_all"] = f"{CLEANED}\n" + "\nunion all ".join(cohorts)
    return sql
