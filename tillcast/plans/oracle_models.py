"""SQL of the ridge queries: two features, whose normal equations have a closed form."""

from __future__ import annotations

from tillcast.operators.ridge import DEFAULT_PENALTY, PENALTIES, POISSON, REFITS, SEED

_COUNT = " + ".join(f"(share >= {edge})::int" for edge in POISSON)


def _solved(penalty: str) -> str:
    """Slopes and intercept from centred second moments."""
    det = f"((v11 + {penalty}) * (v22 + {penalty}) - v12 * v12)"
    b1 = f"(((v22 + {penalty}) * v1y - v12 * v2y) / {det})"
    b2 = f"(((v11 + {penalty}) * v2y - v12 * v1y) / {det})"
    return f"{b1} b1, {b2} b2, ay - a1 * {b1} - a2 * {b2} b0"


PARTS = {
    "r_scale": """
select avg(sales_lag_7) m1, stddev_samp(sales_lag_7) s1, avg(sales_roll_mean_7) m2, stddev_samp(sales_roll_mean_7) s2,
       avg(target_sales_cents) my, stddev_pop(target_sales_cents) sy
from f_rows where split = 'train'""",
    "r_rows": """
select f.*, (sales_lag_7 - m1) / s1 x1, (sales_roll_mean_7 - m2) / s2 x2, (target_sales_cents - my) / sy y, my, sy
from f_rows f, r_scale""",
    "r_moments": """
select avg(x1) a1, avg(x2) a2, avg(y) ay, covar_pop(x1, x1) v11, covar_pop(x1, x2) v12, covar_pop(x2, x2) v22,
       covar_pop(x1, y) v1y, covar_pop(x2, y) v2y
from r_rows where split = 'train'""",
    "r_fits": f"""
select penalty, {_solved('penalty')}
from r_moments, (select unnest([{', '.join(str(p) for p in PENALTIES)}]::double[]) penalty) p""",
    "r_path": """
select penalty, any_value(b0) b0, any_value(b1) b1, any_value(b2) b2,
       avg((y - b0 - b1 * x1 - b2 * x2) ** 2) filter (where split = 'train') train_mse,
       avg((y - b0 - b1 * x1 - b2 * x2) ** 2) filter (where split = 'val') val_mse
from r_rows, r_fits where split in ('train', 'val') group by penalty""",
    "r_chosen": "select * from r_path order by val_mse, penalty desc limit 1",
    "r_predicted": """
select r.*, (b0 + b1 * x1 + b2 * x2) * sy + my predicted from r_rows r, r_chosen""",
    "r_long": """
select split, 'model' predictor, target_sales_cents / 100.0::double a,
       abs(target_sales_cents / 100.0::double - predicted / 100.0::double) e
from r_predicted where is_future = 0
union all
select split, predictor, actual / 100.0::double, abs(actual / 100.0::double - predicted / 100.0::double) from p_long""",
    "r_scores": """
select split, predictor, round_even(avg(e), 2) mae_dollars, round_even(sqrt(avg(e * e)), 2) rmse_dollars,
       round_even(avg(case when a <> 0 then abs(e / a) end) * 100, 2) mape_percent,
       round_even(avg(a), 2) mean_actual_dollars, count(*) n_days
from r_long group by split, predictor""",
    "r_verdict": """
select b.predictor baseline, m.mae_dollars model_mae_dollars, b.mae_dollars baseline_mae_dollars,
       round_even(b.mae_dollars - m.mae_dollars, 2) improvement_dollars,
       case when b.mae_dollars <> 0 then round_even((b.mae_dollars - m.mae_dollars) / b.mae_dollars * 100, 1)
            else 0 end improvement_percent,
       cast(b.mae_dollars > m.mae_dollars as integer) model_wins,
       cast(min(cast(b.mae_dollars > m.mae_dollars as integer)) over () as integer) beats_all_baselines
from r_scores m join r_scores b on m.split = 'test' and b.split = 'test' and m.predictor = 'model'
  and b.predictor <> 'model'""",
    "r_drawn": f"""
select k, x1, x2, y, {_COUNT} w
from (select x1, x2, y, k, ('0x' || md5(business_date::varchar || '|' || location_id || '|{SEED}|' || k)[1:8])::bigint
               / 4294967296.0::double share
      from r_rows, (select unnest(range({REFITS})) k) rounds where split = 'train') draws""",
    "r_refits": f"""
select k, {_solved(str(DEFAULT_PENALTY))}
from (select k, a1, a2, ay, s11 / n - a1 * a1 v11, s12 / n - a1 * a2 v12, s22 / n - a2 * a2 v22,
             s1y / n - a1 * ay v1y, s2y / n - a2 * ay v2y
      from (select k, sum(w) n, sum(w * x1) / sum(w) a1, sum(w * x2) / sum(w) a2, sum(w * y) / sum(w) ay,
                   sum(w * x1 * x1) s11, sum(w * x1 * x2) s12, sum(w * x2 * x2) s22, sum(w * x1 * y) s1y,
                   sum(w * x2 * y) s2y
            from r_drawn group by k) sums) moments""",
}

RAW = {
    "ridge_path": """
select penalty, round(b0, 6) intercept, round(b1, 6) slope_sales_lag_7, round(b2, 6) slope_sales_roll_mean_7,
       round(train_mse, 6) train_mse, round(val_mse, 6) val_mse,
       cast(penalty = (select penalty from r_chosen) as integer) chosen
from r_path""",
    "ridge_predictions": """
select business_date, location_id, split, target_sales_cents, round(predicted, 2) predicted from r_predicted""",
    "ridge_scores": "select * from r_scores",
    "model_verdict": "select * from r_verdict",
    "model_metrics": """
select 'test' split, mae_dollars mae, rmse_dollars rmse, mape_percent mape, mean_actual_dollars mean_actual, n_days,
       replace(replace(baseline, 'baseline_', ''), '_', ' ') baseline, baseline_mae_dollars baseline_mae,
       improvement_dollars improvement, model_wins, beats_all_baselines
from r_scores, r_verdict where split = 'test' and predictor = 'model'""",
    "ridge_uncertainty": """
select business_date, location_id, round(stddev_pop(b0 + b1 * x1 + b2 * x2) * any_value(sy), 2) model_uncertainty
from r_rows, r_refits where split = 'future' group by business_date, location_id""",
    "ridge_explanation": """
select name, direction, contribution from (
  select name, case when s >= 0 then 'up' else 'down' end direction,
         round_even(abs(s) / sum(abs(s)) over (), 4) contribution
  from (select 'sales_lag_7' name, sum(x1 * b1) s from r_next, r_chosen
        union all select 'sales_roll_mean_7', sum(x2 * b2) from r_next, r_chosen) x) y""",
}
PARTS["r_next"] = """
select * from r_rows r where split = 'future' and business_date = (select min(business_date) from r_rows where split = 'future')
  and (sales_roll_mean_28 > 0 or not exists (
    select 1 from r_rows q where q.split = 'future' and q.sales_roll_mean_28 > 0
      and q.business_date = (select min(business_date) from r_rows where split = 'future')))"""
