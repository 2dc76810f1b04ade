"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans: expanding baselines are correlated
self-join aggregates, promotion is a recursive walk, and so on.  Every double
is rounded to 6 digits, counts are BIGINT.
"""

from __future__ import annotations

from spendlens.sources.views import duckdb_with

ORACLES: dict[str, str] = {}

# prior rows of the same user: earlier date, or same date and smaller id
_PRIOR = ("b.user_id = a.user_id and (b.transaction_date < a.transaction_date or "
          "(b.transaction_date = a.transaction_date and b.transaction_id < a.transaction_id))")

ORACLES["txn_features"] = duckdb_with("txn_star") + f"""
, cat as (
  select a.transaction_id, count(b.amount) as n, avg(b.amount) as mean, stddev_samp(b.amount) as sd
  from txn_star a left join txn_star b on {_PRIOR} and b.category is not distinct from a.category
  group by a.transaction_id),
mer as (
  select a.transaction_id, count(b.amount) as n, avg(b.amount) as mean, stddev_samp(b.amount) as sd
  from txn_star a left join txn_star b on {_PRIOR} and b.merchant = a.merchant and a.merchant <> ''
  group by a.transaction_id),
f as (
  select t.transaction_id, t.user_id, t.amount, t.merchant,
    ln(1 + greatest(t.amount, 0)) as log_amount,
    case when coalesce(cat.sd, 0) > 0 then (t.amount - cat.mean) / cat.sd else 0.0 end as cz,
    case when coalesce(t.merchant, '') <> '' and coalesce(mer.sd, 0) > 0
         then (t.amount - mer.mean) / mer.sd else 0.0 end as mz,
    case when coalesce(t.merchant, '') <> '' and mer.n = 0 then 1.0 else 0.0 end as is_new,
    cast(isodow(t.transaction_date) - 1 as double) as dow,
    case when isodow(t.transaction_date) >= 6 then 1.0 else 0.0 end as wknd,
    cat.n as cn, cat.mean as cmean, mer.n as mn, mer.mean as mmean
  from txn_star t join cat using (transaction_id) join mer using (transaction_id)),
r as (
  select *, case when is_new = 1 then 'new_merchant'
                 when cz >= 2.5 and cn > 0 and cmean > 0 then 'category_spike'
                 when coalesce(merchant, '') <> '' and mz >= 2.5 and mn > 0 and mmean > 0 then 'merchant_spike'
                 when wknd = 1 then 'weekend' else 'generic' end as code
  from f)
select transaction_id, user_id, round(log_amount, 6) as log_amount, round(cz, 6) as category_zscore,
  round(mz, 6) as merchant_zscore, is_new as is_new_merchant, dow as day_of_week, wknd as is_weekend,
  cn as prior_category_n, mn as prior_merchant_n, code as reason_code,
  round(case code when 'category_spike' then cmean when 'merchant_spike' then mmean end, 6) as typical_amount,
  round(case when code = 'category_spike' then amount / cmean end, 6) as multiple
from r"""

_STATEMENT = duckdb_with("raw_statement") + r"""
, c as (
  select user_id, file_id, row_key, layout, trim(date_raw) as d, trim(desc_raw) as ds,
    case when layout <> 1 then amt_raw end as amount_cell,
    case when layout = 1 then (case when row_key % 2 = 1 then amt_raw else '' end) end as debit_cell,
    case when layout = 1 then (case when row_key % 2 = 0 then amt_raw else '' end) end as credit_cell,
    case when layout in (0, 3) then type_raw end as type_cell,
    case when layout = 3 then merchant_raw end as merchant_cell,
    row_number() over (partition by user_id, file_id order by row_key) + 1 as row_num
  from raw_statement),
k as (
  select *,
    replace(replace(replace(trim(coalesce(amount_cell, '')), ',', ''), '₹', ''), '$', '') as a_s,
    replace(replace(replace(trim(coalesce(debit_cell, '')), ',', ''), '₹', ''), '$', '') as d_s,
    replace(replace(replace(trim(coalesce(credit_cell, '')), ',', ''), '₹', ''), '$', '') as c_s,
    try_strptime(regexp_replace(d, ' +', ' ', 'g'),
      ['%Y-%m-%d','%d/%m/%Y','%m/%d/%Y','%d-%m-%Y','%Y/%m/%d','%d %b %Y','%d-%b-%Y']) as dt
  from c),
v as (
  select *,
    case when regexp_full_match(a_s, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') then try_cast(trim(a_s) as double) end as a_v,
    coalesce(case when regexp_full_match(d_s, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') then try_cast(trim(d_s) as double) end, 0) as d_v,
    coalesce(case when regexp_full_match(c_s, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') then try_cast(trim(c_s) as double) end, 0) as c_v
  from k),
t as (
  select *,
    case when layout = 1 then (case when d_v <> 0 then abs(d_v) when c_v <> 0 then abs(c_v) end)
         else abs(a_v) end as amt,
    case when layout = 1 then (case when d_v <> 0 then 'debit' when c_v <> 0 then 'credit' end)
         when a_v is null then null
         when layout in (0, 3) then (case when lower(trim(type_cell)) in ('credit', 'cr', 'c') then 'credit' else 'debit' end)
         else (case when a_v > 0 then 'credit' else 'debit' end) end as ttype
  from v),
e as (
  select *,
    case when d = '' then 'Missing transaction date'
         when ds = '' then 'Missing description'
         when dt is null then 'Unrecognized date format: ''' || d || ''''
         when layout <> 1 and a_v is null then 'Unrecognized amount value: ''' || amount_cell || ''''
         when amt is null or ttype is null then 'Could not determine a valid amount and transaction type for this row'
         when amt = 0 then 'Transaction amount is zero' end as error
  from t),
rows as (
  select user_id, file_id, cast(row_num as int) as row_num,
    case when error is null then dt end as transaction_date,
    case when error is null then ds end as description,
    case when error is null and layout = 3 then nullif(trim(merchant_cell), '') end as merchant,
    case when error is null then round(amt, 6) end as amount,
    case when error is null then ttype end as transaction_type,
    case when error is null then 'INR' end as currency,
    cast(null as varchar) as reference, error,
    case when error is null then sha256(concat_ws('|', user_id::varchar, strftime(dt, '%Y-%m-%dT%H:%M:%S'),
         ds, amt::varchar, ttype)) end as content_hash
  from e)
"""

ORACLES["statement_rows"] = _STATEMENT + "select * from rows"

ORACLES["import_summary"] = _STATEMENT + """
, ranked as (select *, row_number() over (partition by user_id, file_id order by row_num) as rk
             from rows where error is not null)
select r.user_id, r.file_id, count(*) as total_rows,
  count(*) filter (where r.error is null) as imported_rows,
  count(*) filter (where r.error is not null) as failed_rows,
  case when count(*) filter (where r.error is null) = 0 then 'failed'
       when count(*) filter (where r.error is not null) > 0 then 'partial' else 'completed' end as status,
  (select string_agg(x.row_num || ':' || x.error, ' | ' order by x.row_num) from ranked x
    where x.user_id = r.user_id and x.file_id = r.file_id and x.rk <= 50) as first_errors
from rows r group by r.user_id, r.file_id"""

ORACLES["duplicate_uploads"] = duckdb_with("uploads") + """
select file_seq, user_id, file_hash,
  row_number() over w = 1 as accepted,
  case when row_number() over w > 1 then first_value(file_seq) over w end as duplicate_of
from uploads window w as (partition by user_id, file_hash order by file_seq)"""

_TEXT = duckdb_with("labelled_text") + r"""
, clean as (
  select id, category,
    array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(description),
      '\b\d{4,}\b', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+'),
      lambda x: x <> '' and x not in ('upi','pos','neft','imps','ref','txn','wdl','no')), ' ') as clean_description,
    row_number() over (partition by category order by md5(id::varchar || '|42'), id)
      <= (case when count(*) over (partition by category) >= 2
               then greatest(1, floor(count(*) over (partition by category) / 5 + 0.5)) else 0 end) as is_test
  from labelled_text),
toks as (select *, list_filter(string_split(clean_description, ' '), lambda x: length(x) >= 2) as u from clean),
docs as (select id, category, is_test, clean_description, len(u) as n_u,
           u || [u[i] || ' ' || u[i + 1] for i in range(1, len(u))] as terms from toks),
tf as (select id, term, count(*) as tf from (select id, unnest(terms) as term from docs) group by id, term),
train_n as (select count(*) as n from docs where not is_test),
idf as (select term, ln((1 + (select n from train_n)) / (1 + count(*))) + 1 as idf
        from tf where id in (select id from docs where not is_test) group by term),
w as (select tf.id, tf.term, tf.tf * idf.idf as w from tf join idf using (term)),
x as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as weight from w),
train_x as (select x.*, d.category from x join docs d using (id) where not d.is_test),
fc as (select category, term, sum(weight) as fc from train_x group by category, term),
cls as (select category, count(*) as n_c from docs where not is_test group by category),
vocab as (select count(*) as v from idf),
cls2 as (select c.category, ln(c.n_c / (select sum(n_c) from cls)) as log_prior,
           ln(coalesce((select sum(fc) from fc f where f.category = c.category), 0) + (select v from vocab)) as log_norm
         from cls c),
test_docs as (select id, category as truth from docs where is_test),
jll as (
  select t.id, c.category,
    c.log_prior + coalesce((select sum(x.weight * (ln(coalesce(f.fc, 0) + 1) - c.log_norm))
                            from x left join fc f on f.term = x.term and f.category = c.category
                            where x.id = t.id), 0) as j
  from test_docs t, cls2 c),
best as (
  select id, arg_min(category, struct_pack(neg := -j, cat := category)) as predicted
  from jll group by id),
conf as (
  select id, 1.0 / sum(exp(j - mx)) as confidence from (
    select id, j, max(j) over (partition by id) as mx from jll) group by id),
pred as (select t.id, t.truth, b.predicted, c.confidence from test_docs t join best b using (id) join conf c using (id))
"""

ORACLES["text_terms"] = _TEXT + """
select id, clean_description, cast(n_u as bigint) as n_unigrams, cast(len(terms) as bigint) as n_terms from docs"""

ORACLES["text_split"] = _TEXT + "select id, category, is_test from docs"

ORACLES["class_balance"] = _TEXT + """
select category, n_c, round((select sum(n_c) from cls) / ((select count(*) from cls) * n_c), 6) as weight from cls"""

ORACLES["tfidf_weights"] = _TEXT + """
select id, term, round(weight, 6) as weight from x where id in (select id from docs where not is_test)"""

ORACLES["nb_predictions"] = _TEXT + """
select id, truth, predicted, round(confidence, 6) as confidence from pred"""

_LABELS = """
, lab as (
  select label, coalesce(tp, 0)::double as tp, coalesce(support, 0)::double as support,
         coalesce(pn, 0)::double as pn
  from (select truth as label, count(*) as support, count(*) filter (where truth = predicted) as tp from pred group by truth) a
  full outer join (select predicted as label, count(*) as pn from pred group by predicted) b using (label)),
m as (
  select label, support, tp,
    case when pn > 0 then tp / pn else 0 end as precision,
    case when support > 0 then tp / support else 0 end as recall,
    case when tp + pn + support > 0 then 2 * tp / (pn + support) else 0 end as f1
  from lab)
"""

ORACLES["nb_confusion"] = _TEXT + "select truth, predicted, count(*) as n from pred group by truth, predicted"

ORACLES["nb_metrics"] = _TEXT + _LABELS + """
select round(sum(tp) / sum(support), 6) as accuracy, round(avg(f1), 6) as macro_f1,
  round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall from m"""

ORACLES["nb_report"] = _TEXT + _LABELS + """
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
  cast(support as bigint) as support from m
union all select 'accuracy', null, null, round(sum(tp) / sum(support), 6), cast(sum(support) as bigint) from m
union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as bigint) from m
union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from m"""

ORACLES["history_gate"] = duckdb_with("txn_star") + """
select user_id, count(*) as transactions_scanned, count(*) >= 10 as eligible,
  case when count(*) < 10 then 'Need at least 10 transactions for anomaly detection; you have '
       || count(*) || '.' end as message
from txn_star group by user_id"""

ORACLES["score_normalize"] = duckdb_with("txn_star") + """
, r as (select transaction_id, user_id, -ln(1 + amount) as raw from txn_star),
s as (select *, max(raw) over (partition by user_id) as hi, min(raw) over (partition by user_id) as lo from r)
select transaction_id, user_id,
  round(case when hi - lo > 1e-9 then (hi - raw) / (hi - lo) else 0.0 end, 6) as anomaly_score,
  case when (case when hi - lo > 1e-9 then (hi - raw) / (hi - lo) else 0.0 end) >= 0.75 then 'high'
       when (case when hi - lo > 1e-9 then (hi - raw) / (hi - lo) else 0.0 end) >= 0.5 then 'medium'
       else 'low' end as severity
from s"""

ORACLES["binary_metrics"] = """
with c as (select count(*) filter (where quality = 1 and toxic = 1) as tp,
                  count(*) filter (where quality <> 1 and toxic = 1) as fp,
                  count(*) filter (where quality = 1 and toxic <> 1) as fn,
                  count(*) filter (where toxic = 1) as flagged,
                  count(*) filter (where quality = 1) as injected, count(*) as n from labels)
select round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision,
  round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall,
  round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1,
  round(case when n > 0 then flagged / n else 0 end, 6) as flagged_rate,
  round(case when n > 0 then injected / n else 0 end, 6) as injected_rate
from c"""

ORACLES["model_promotion"] = duckdb_with("metric_history").replace("with ", "with recursive ", 1) + """
, walk(model_name, version, best, promoted) as (
  select model_name, version, coalesce(score, '-inf'::double), true from metric_history where version = 1
  union all
  select m.model_name, m.version,
    greatest(w.best, coalesce(m.score, '-inf'::double)),
    coalesce(m.score, '-inf'::double) >= w.best
  from walk w join metric_history m on m.model_name = w.model_name and m.version = w.version + 1)
select w.model_name, w.version, round(m.score, 6) as score, w.promoted
from walk w join metric_history m using (model_name, version)"""

ORACLES["model_status"] = duckdb_with("metric_history").replace("with ", "with recursive ", 1) + """
, walk(model_name, version, best, promoted) as (
  select model_name, version, coalesce(score, '-inf'::double), true from metric_history where version = 1
  union all
  select m.model_name, m.version,
    greatest(w.best, coalesce(m.score, '-inf'::double)),
    coalesce(m.score, '-inf'::double) >= w.best
  from walk w join metric_history m on m.model_name = w.model_name and m.version = w.version + 1)
select model_name, max(version) filter (where promoted) is not null as is_ready,
  max(version) filter (where promoted) as active_version, max(version) as latest_version,
  coalesce(max(version), 0) + 1 as next_version, count(*) as versions
from walk group by model_name"""

ORACLES["transactions_page"] = duckdb_with("txn_star") + """
, d as (select * from txn_star where transaction_type = 'debit'),
r as (select *, row_number() over (partition by user_id order by transaction_date desc, transaction_id) as position,
             count(*) over (partition by user_id) as total from d)
select user_id, position, total, transaction_id, transaction_date, description, merchant,
  round(amount, 6) as amount, currency, transaction_type, category, import_id
from r where position <= 50"""

ORACLES["imports_page"] = duckdb_with("uploads") + """
, a as (select * from uploads u where not exists (
          select 1 from uploads e where e.user_id = u.user_id and e.file_hash = u.file_hash and e.file_seq < u.file_seq)),
r as (select *, row_number() over (partition by user_id order by file_seq desc) as position,
             count(*) over (partition by user_id) as total from a)
select user_id, file_seq, file_hash, position, total from r where position <= 20"""

ORACLES["retention_window"] = duckdb_with("txn_star") + """
select transaction_id, user_id, transaction_date from txn_star
where transaction_date >= (select max(transaction_date) from txn_star) - interval 90 days"""

ORACLES["unique_key_audit"] = duckdb_with("uploads") + """
select user_id, file_hash, count(*) as n from uploads group by user_id, file_hash having count(*) > 1"""

ORACLES["category_defaults"] = duckdb_with("txn_star") + """
, existing as (select distinct category as name, user_id::varchar as user_id, false as is_system from txn_star),
defaults as (select unnest(['Food', 'Groceries', 'Transportation', 'Travel', 'Shopping',
    'Entertainment', 'Bills', 'Utilities', 'Healthcare', 'Education', 'Rent', 'Salary', 'Investment',
    'Transfer', 'Subscription', 'Cash Withdrawal', 'Other']) as name, null::varchar as user_id, true as is_system)
select * from existing
union all
select * from defaults d where not exists (
  select 1 from existing e where e.name is not distinct from d.name and e.user_id is not distinct from d.user_id)"""

_W5 = duckdb_with("txn_star") + """
, r as (select transaction_id, user_id, is_injected_anomaly, -ln(1 + amount) as raw,
          count(*) over (partition by user_id) as n,
          max(-ln(1 + amount)) over (partition by user_id) as hi,
          min(-ln(1 + amount)) over (partition by user_id) as lo from txn_star),
scored as (select *, case when hi - lo > 1e-9 then (hi - raw) / (hi - lo) else 0.0 end as anomaly_score
           from r where n >= 10)
"""

ORACLES["anomaly_flags_update"] = _W5 + """
select t.transaction_id, t.user_id, coalesce(s.anomaly_score >= 0.75, false) as is_anomaly,
  round(s.anomaly_score, 6) as anomaly_score
from txn_star t left join scored s using (transaction_id)"""

ORACLES["anomaly_replace"] = _W5 + """
select user_id, transaction_id, 'previous' as source from txn_star
where is_injected_anomaly = 1 and user_id in (select user_id from txn_star group by user_id having count(*) < 10)
union all
select user_id, transaction_id, 'current' from scored where anomaly_score >= 0.75"""

ORACLES["import_rescan"] = _W5 + """
select user_id, transaction_id, round(anomaly_score, 6) as anomaly_score, 'high' as severity
from scored where anomaly_score >= 0.75"""

ORACLES["history_features_a"] = duckdb_with("txn_star") + """
, d as (select *, coalesce(merchant, description) as merchant_key from txn_star),
s as (select *,
  count(*) over (partition by user_id, merchant_key) as mk_n,
  avg(amount) over (partition by user_id, merchant_key) as mk_mean,
  stddev_samp(amount) over (partition by user_id, merchant_key) as mk_sd,
  count(*) over (partition by user_id, category) as ck_n,
  avg(amount) over (partition by user_id, category) as ck_mean,
  stddev_samp(amount) over (partition by user_id, category) as ck_sd from d)
select transaction_id, user_id, merchant_key, round(ln(1 + abs(amount)), 6) as log_amount,
  cast(isodow(transaction_date) - 1 as double) as day_of_week, cast(day(transaction_date) as double) as day_of_month,
  case when merchant_key is not null then mk_n::double end as merchant_frequency,
  case when merchant_key is not null and mk_n = 1 then 1 else 0 end as is_new_merchant,
  case when category is not null then ck_n::double end as category_frequency,
  round(case when category is not null and ck_sd is not null and ck_sd <> 0 then (amount - ck_mean) / ck_sd else 0.0 end, 6) as amount_zscore_category,
  round(case when merchant_key is not null and mk_sd is not null and mk_sd <> 0 then (amount - mk_mean) / mk_sd else 0.0 end, 6) as amount_zscore_merchant
from s"""

ORACLES["history_features_b"] = duckdb_with("txn_star") + """
, d as (select *, coalesce(merchant, 'UNKNOWN_MERCHANT') as mb from txn_star),
s as (select *,
  count(*) over (partition by user_id, mb) as mb_n,
  avg(amount) over (partition by user_id, mb) as mb_mean,
  stddev_samp(amount) over (partition by user_id, mb) as mb_sd,
  count(*) over (partition by user_id, category) as cb_n,
  avg(amount) over (partition by user_id, category) as cb_mean,
  stddev_samp(amount) over (partition by user_id, category) as cb_sd,
  count(*) over (partition by user_id) as total from d)
select transaction_id, user_id, round(ln(1 + amount), 6) as log_amount,
  round((amount - cb_mean) / (case when cb_n > 1 and cb_sd > 0 then cb_sd else 1.0 end), 6) as category_amount_zscore,
  round((amount - mb_mean) / (case when mb_n > 1 and mb_sd > 0 then mb_sd else 1.0 end), 6) as merchant_amount_zscore,
  round(mb_n / total, 6) as merchant_frequency_ratio,
  round(case when category is not null then cb_n / total end, 6) as category_frequency_ratio,
  case when mb_n <= 1 then 1 else 0 end as is_new_merchant,
  cast(isodow(transaction_date) - 1 as double) as day_of_week, cast(day(transaction_date) as double) as day_of_month
from s"""

ORACLES["monthly_kpis"] = duckdb_with("txn_star") + """
, m as (select user_id, date_trunc('month', transaction_date)::date as month,
          sum(case when transaction_type = 'credit' then amount else 0 end) as income,
          sum(case when transaction_type = 'debit' then amount else 0 end) as expense
        from txn_star group by all),
k as (select *, income - expense as net,
        sum(income - expense) over (partition by user_id order by month rows between unbounded preceding and current row) as balance,
        lag(expense) over (partition by user_id order by month) as prev from m)
select user_id, month, round(income, 2) as income, round(expense, 2) as expense, round(net, 2) as net,
  round(balance, 2) as balance, round(case when income <> 0 then net / income end, 2) as savings_rate,
  round(case when prev <> 0 then (expense - prev) / prev end, 2) as expense_change
from k"""

ORACLES["spending_rollup"] = duckdb_with("txn_star") + """
, d as (select date_trunc('month', transaction_date)::date as period, category, amount from txn_star
        where transaction_type = 'debit')
select period, category, 0::bigint as level, round(sum(amount), 2) as debit_total, count(*) as debit_count,
  round(avg(amount), 2) as debit_avg from d group by period, category
union all
select period, null, 1, round(sum(amount), 2), count(*), round(avg(amount), 2) from d group by period
union all
select null, null, 3, round(sum(amount), 2), count(*), round(avg(amount), 2) from d"""

ORACLES["recurring_payments"] = duckdb_with("txn_star") + """
, d as (select user_id, merchant, amount, transaction_date::date as day, transaction_id from txn_star
        where transaction_type = 'debit' and merchant is not null and merchant <> ''),
g as (select *, day - lag(day) over (partition by user_id, merchant order by day, transaction_id) as gap from d),
a as (select user_id, merchant, count(*) as payments, avg(amount) as avg_amount,
        quantile_cont(gap, 0.5) as median_gap, avg(gap) as mean_gap, stddev_samp(gap) as std_gap,
        max(day) as last_date from g group by user_id, merchant having count(*) >= 3),
f as (select *, case when median_gap between 1 and 1 then 'DAILY' when median_gap between 6 and 8 then 'WEEKLY'
                     when median_gap between 26 and 35 then 'MONTHLY' when median_gap between 350 and 380 then 'YEARLY'
                end as frequency from a)
select user_id, merchant, frequency, payments, round(avg_amount, 4) as avg_amount, round(median_gap, 4) as median_gap,
  round(greatest(0.0, 1.0 - coalesce(case when mean_gap <> 0 then std_gap / mean_gap end, 0.0)), 4) as confidence,
  last_date + floor(median_gap)::int as next_date
from f where frequency is not null"""

ORACLES["spend_forecast"] = duckdb_with("txn_star") + """
, daily as (select user_id, transaction_date::date as day, sum(amount) as x from txn_star
            where transaction_type = 'debit' group by all),
span as (select user_id, min(day) as t0, max(day) as t1 from daily group by user_id),
filled as (select s.user_id, g.day::date as day, coalesce(d.x, 0.0) as x
           from span s, generate_series(s.t0, s.t1, interval 1 day) g(day)
           left join daily d on d.user_id = s.user_id and d.day = g.day::date),
series as (select user_id, list({'l': x, 's1': 0.0::double, 's2': 0.0::double} order by day) as xs, count(*) as days from filled group by user_id),
folded as (select user_id, days, list_reduce(xs, lambda acc, x: {'l': 0.3 * x.l + 0.7 * acc.l,
             's1': acc.s1 + (x.l - acc.l), 's2': acc.s2 + (x.l - acc.l) * (x.l - acc.l)}) as z from series),
lv as (select user_id, days, z.l as level,
         case when days >= 3 then sqrt(greatest(0.0, (z.s2 - z.s1 * z.s1 / (days - 1)) / (days - 2))) else 0.0 end as sd from folded),
h as (select *, unnest([7, 30, 90]) as horizon_days from lv)
select user_id, horizon_days, days, floor(level * horizon_days * 100 + 0.5001) / 100 as forecast,
  floor(greatest(0.0, level * horizon_days - 1.96 * sd * sqrt(horizon_days)) * 100 + 0.5001) / 100 as lower,
  floor((level * horizon_days + 1.96 * sd * sqrt(horizon_days)) * 100 + 0.5001) / 100 as upper
from h"""

ORACLES["insights"] = duckdb_with("txn_star") + """
, d as (select * from txn_star where transaction_type = 'debit'),
c as (select user_id, category, sum(amount) as v from d group by all),
mc as (select user_id, merchant, sum(amount) as v from d where merchant is not null and merchant <> '' group by all),
m as (select user_id, date_trunc('month', transaction_date)::date as month,
        sum(case when transaction_type = 'debit' then amount else 0 end) as expense from txn_star group by all),
ch as (select user_id, month, expense - lag(expense) over (partition by user_id order by month) as delta from m)
select user_id, 'top_category' as insight, arg_min(category, struct_pack(a := -v, b := category)) as label,
  round(max(v), 2) as value from c group by user_id
union all
select user_id, 'top_merchant', arg_min(merchant, struct_pack(a := -v, b := merchant)), round(max(v), 2) from mc group by user_id
union all
select user_id, 'largest_monthly_change', strftime(arg_min(month, struct_pack(a := -abs(delta), b := month)), '%Y-%m'),
  round(arg_min(delta, struct_pack(a := -abs(delta), b := month)), 2) from ch where delta is not null group by user_id"""

ORACLES["event_features"] = duckdb_with("txn_events") + """
, p as (
  select a.event_id,
    count(b.amount) filter (where b.category is not distinct from a.category) as cn,
    avg(b.amount) filter (where b.category is not distinct from a.category) as cm,
    stddev_samp(b.amount) filter (where b.category is not distinct from a.category) as cs,
    count(b.amount) filter (where b.merchant = a.merchant and a.merchant <> '') as mn,
    avg(b.amount) filter (where b.merchant = a.merchant and a.merchant <> '') as mm,
    stddev_samp(b.amount) filter (where b.merchant = a.merchant and a.merchant <> '') as ms
  from txn_events a left join txn_events b on b.user_id = a.user_id
    and (b.ts < a.ts or (b.ts = a.ts and b.event_id < a.event_id))
  group by a.event_id)
select e.event_id, e.user_id,
  round(case when coalesce(cs, 0) > 0 then (e.amount - cm) / cs else 0.0 end, 6) as category_zscore,
  round(case when coalesce(e.merchant, '') <> '' and coalesce(ms, 0) > 0 then (e.amount - mm) / ms else 0.0 end, 6) as merchant_zscore,
  case when coalesce(e.merchant, '') <> '' and mn = 0 then 1.0 else 0.0 end as is_new_merchant,
  cn as prior_category_n, case when coalesce(e.merchant, '') <> '' then mn else 0 end as prior_merchant_n
from txn_events e join p using (event_id)"""

ORACLES["statement_files"] = _STATEMENT + """
select user_id, row_num, transaction_date, description, merchant, amount, transaction_type, currency,
  reference, error, content_hash from rows"""

# ---------------------------------------------------------------- linear models at given weights
# the weight of a term for class i (from 1) and the intercept: a rule, the same in the plan
_LINEAR = _TEXT + """
, k as (select category, row_number() over (order by category) as i,
          (select sum(n_c) from cls) / ((select count(*) from cls) * n_c) as cw from cls),
given as (select k.category, term, ((length(term) + 3 * k.i) % 7 - 3) / 10.0 as w from idf, k),
margin as (
  select d.id, d.category as truth, d.is_test, k.category, k.i, k.cw, 0.1 * k.i
           + coalesce((select sum(x.weight * ((length(x.term) + 3 * k.i) % 7 - 3) / 10.0) from x where x.id = d.id), 0) as m
  from docs d, k)
"""

ORACLES["svm_gradient"] = _LINEAR + """
, s as (select *, case when truth = category then 1.0 else -1.0 end as y,
          case when truth = category then cw else 1.0 end as c from margin where not is_test),
l as (select *, greatest(0.0, 1 - y * m) as slack from s),
g as (
  select category, term, sum(-2 * c * y * slack * weight) as g from l join x using (id) group by category, term),
gw as (select g.category, sum((g.g + v.w) * (g.g + v.w)) as gg, sum(v.w * v.w) as ww
       from g join given v on v.category = g.category and v.term = g.term group by g.category),
b as (select category, any_value(i) as i, sum(-2 * c * y * slack) as gb, sum(c * slack * slack) as loss from l group by category)
select category, round(loss + 0.5 * (ww + (0.1 * i) * (0.1 * i)), 4) as objective,
  round(sqrt(gg + (gb + 0.1 * i) * (gb + 0.1 * i)), 4) as gradient_norm, round(gb + 0.1 * i, 4) as intercept_gradient
from b join gw using (category)"""

ORACLES["categorizer_margins"] = _LINEAR + """
, t as (select * from margin where is_test)
select id, arg_min(category, struct_pack(neg := -m, cat := category)) as predicted, round(max(m), 6) as margin,
  round(exp(max(m)) / sum(exp(m)), 6) as confidence
from t group by id"""

# ---------------------------------------------------------------- the detection side at a given score
_FLAG = duckdb_with("txn_star") + """
, s as (select transaction_id, user_id, case when transaction_type = 'credit' then -8.0 else -ln(1 + amount) end as score from txn_star),
q as (select quantile_cont(score, 0.05) as threshold from s)
"""

ORACLES["flag_threshold"] = _FLAG + """
select round(any_value(threshold), 6) as threshold, count(*) as n, count(*) filter (where score < threshold) as flagged,
  round((select quantile_cont(score, 0.9) from s), 6) as upper from s, q"""

ORACLES["scan_summary"] = _FLAG + """
, u as (select user_id, count(*) as n, count(*) filter (where score < threshold) as k from s, q group by user_id)
select user_id, case when n < 10 then 'insufficient_data' else 'completed' end as status,
  case when n < 10 then 'Need at least 10 transactions for anomaly detection; you have ' || n || '.'
       else 'Scanned ' || n || ' transactions, found ' || k || ' anomalies.' end as message,
  case when n < 10 then 0 else k end as anomalies_found, n as transactions_scanned from u"""

ORACLES["forest_path_score"] = """
with f as (""" + ORACLES["txn_features"] + """),
c(n, c) as (select n, case when n <= 1 then 0.0 when n = 2 then 1.0
              else 2 * (ln(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n end from range(1, 9) r(n)),
leaves as (
  select transaction_id, user_id,
    case when log_amount <= 9.8765 then [1, 3] when category_zscore <= 0.54321 then [2, 1] else [2, 4] end as a,
    case when is_new_merchant <= 0.5 then (case when day_of_week <= 3.5 then [2, 2] else [2, 5] end) else [1, 1] end as b,
    case when merchant_zscore <= -0.12345 then [1, 6] when is_weekend <= 0.5 then [2, 1] else [2, 1] end as c3
  from f),
h as (select l.*, (a[1] + ca.c + b[1] + cb.c + c3[1] + cc.c) / 3 as path
      from leaves l join c ca on ca.n = a[2] join c cb on cb.n = b[2] join c cc on cc.n = c3[2])
select transaction_id, user_id, round(-pow(2.0, -path / (select c from c where n = 8)), 6) as score,
  -pow(2.0, -path / (select c from c where n = 8)) + 0.55 < 0 as is_anomaly
from h"""

ORACLES["anomalies_page"] = _W5 + """
, a as (select s.user_id, s.transaction_id, s.anomaly_score, t.transaction_date as created_at
        from scored s join txn_star t using (transaction_id) where s.anomaly_score >= 0.75),
paged as (select *, row_number() over (partition by user_id order by created_at desc, transaction_id) as position,
             count(*) over (partition by user_id) as total from a)
select user_id, sha256(user_id || '|' || transaction_id) as anomaly_id, transaction_id, round(anomaly_score, 6) as anomaly_score,
  'high' as severity, 'amount' as reason, created_at, position, total
from paged where position <= 50"""

ORACLES["unique_keys"] = duckdb_with("txn_star", "uploads", "metric_history") + """
, keys as (
  select 'transaction_imports' as "table", user_id || '|' || file_hash as key from uploads
  union all select 'categories', category || '|' || user_id from txn_star
  union all select 'anomalies', transaction_id from txn_star where is_injected_anomaly = 1
  union all select 'recurring_transactions', user_id || '|' || coalesce(merchant, 'NULL') from txn_star where transaction_type = 'debit'
  union all select 'ml_models', model_name || '|' || (version // 2) from metric_history)
select "table", key, count(*) as n from keys group by all having count(*) > 1"""

ORACLES["owned_lookup"] = duckdb_with("txn_star") + """
select transaction_id, user_id, round(amount, 6) as amount from txn_star where transaction_type <> 'credit'"""

_GRAIN = """
select '{g}' as grain, date_trunc('{g}', transaction_date)::date as period, category,
  grouping(date_trunc('{g}', transaction_date)::date) * 2 + grouping(category) as level, round(sum(amount), 2) as debit_total,
  count(*) as debit_count, (round(sum(amount) * 100)::bigint // count(*)) / 100 as debit_avg
from txn_star where transaction_type = 'debit' group by rollup (date_trunc('{g}', transaction_date)::date, category)"""
ORACLES["spending_grains"] = duckdb_with("txn_star") + _GRAIN.format(g="day") + " union all " + _GRAIN.format(g="week")
