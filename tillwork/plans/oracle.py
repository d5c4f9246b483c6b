"""The same answers as :mod:`catalog` in ANSI SQL over the star-schema tables, for checking results in another engine."""

from __future__ import annotations

import re

# Shared parts; a part may use others, ``with_parts`` puts those in front.
PARTS: dict[str, str] = {
    "cust": """SELECT c_custkey, c_name, c_mktsegment, r_name AS branch
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ord": """SELECT o_orderkey, o_custkey, c_name, c_mktsegment, branch, o_totalprice, o_orderdate,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'DELIVERY' ELSE 'IN_STORE' END AS channel
        FROM orders JOIN cust ON o_custkey = c_custkey""",
    "line": """SELECT CAST(l_orderkey AS VARCHAR) AS order_id, p_name AS item, branch, channel, o_orderdate AS ts
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN ord ON l_orderkey = o_orderkey""",
    "pres": "SELECT DISTINCT order_id, item, branch, channel FROM line",
    "scoped": """SELECT s.scope_type, p.order_id, p.item,
        CASE WHEN s.scope_type IN ('branch', 'branch_channel') THEN p.branch END AS branch,
        CASE WHEN s.scope_type IN ('channel', 'branch_channel') THEN p.channel END AS channel
        FROM pres p, (VALUES ('overall'), ('branch'), ('channel'), ('branch_channel')) AS s(scope_type)""",
    "n_ord": """SELECT scope_type, branch, channel, count(DISTINCT order_id) AS n_orders FROM scoped GROUP BY ALL""",
    "n_item": """SELECT scope_type, branch, channel, item, count(*) AS n FROM scoped GROUP BY ALL""",
    "n_pair": """SELECT x.scope_type, x.branch, x.channel, x.item AS item_a, y.item AS item_b, count(*) AS count_ab
        FROM scoped x JOIN scoped y ON x.order_id = y.order_id AND x.scope_type = y.scope_type AND x.item < y.item
        GROUP BY ALL HAVING count(*) >= 10""",
    "pairs": """SELECT CASE p.scope_type WHEN 'overall' THEN 'overall' WHEN 'branch' THEN 'branch:' || p.branch
            WHEN 'channel' THEN 'channel:' || p.channel ELSE 'branch:' || p.branch || '|channel:' || p.channel END AS scope,
        p.scope_type, p.branch, p.channel, p.item_a, p.item_b, o.n_orders, a.n AS count_a, b.n AS count_b, p.count_ab,
        p.count_ab::DOUBLE / o.n_orders AS support0, p.count_ab::DOUBLE / a.n AS ab0, p.count_ab::DOUBLE / b.n AS ba0,
        p.count_ab::DOUBLE * o.n_orders / (a.n::DOUBLE * b.n) AS lift0,
        round(p.count_ab::DOUBLE / o.n_orders, 6) AS support, round(p.count_ab::DOUBLE / a.n, 6) AS confidence_ab,
        round(p.count_ab::DOUBLE / b.n, 6) AS confidence_ba, round(p.count_ab::DOUBLE * o.n_orders / (a.n::DOUBLE * b.n), 6) AS lift
        FROM n_pair p
        JOIN n_ord o ON p.scope_type = o.scope_type AND p.branch IS NOT DISTINCT FROM o.branch AND p.channel IS NOT DISTINCT FROM o.channel
        JOIN n_item a ON p.scope_type = a.scope_type AND p.branch IS NOT DISTINCT FROM a.branch AND p.channel IS NOT DISTINCT FROM a.channel AND a.item = p.item_a
        JOIN n_item b ON p.scope_type = b.scope_type AND p.branch IS NOT DISTINCT FROM b.branch AND p.channel IS NOT DISTINCT FROM b.channel AND b.item = p.item_b
        WHERE p.count_ab::DOUBLE / o.n_orders >= 0.001""",
    "bask": """SELECT order_id, branch, channel, ts, list_sort(list(DISTINCT item)) AS items FROM line GROUP BY ALL""",
    "months": """SELECT branch, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM ord GROUP BY ALL""",
    "menu": """SELECT branch, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'DELIVERY' WHEN 'BUILDING' THEN 'TABLE' ELSE c_mktsegment END AS channel,
        CAST(count(DISTINCT o_custkey) AS DOUBLE) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sales
        FROM ord GROUP BY ALL""",
    "item0": """SELECT branch, p_type AS division, p_brand || CASE WHEN p_size = 1 THEN '/free' ELSE '/paid' END AS "group", p_name AS item,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
        CAST(sum(CASE WHEN p_size = 1 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS amount
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN ord ON l_orderkey = o_orderkey GROUP BY ALL""",
    "items": """SELECT *, amount = 0 AND qty > 0 AS is_modifier,
        CASE WHEN amount = 0 AND qty > 0 THEN 'modifier' ELSE 'core_food' END AS category FROM item0""",
    "drinks": """SELECT branch, replace(replace(division || ' ' || item, 'hot', 'hot coffee'), 'cold', 'iced coffee') AS division, "group", item, qty, amount, is_modifier,
        CASE WHEN contains(item, 'cold') THEN 'coffee_cold' WHEN contains(item, 'hot') THEN 'coffee_hot' WHEN is_modifier THEN 'modifier' ELSE 'core_food' END AS category FROM items""",
    "buyers0": """SELECT branch, c_name AS customer, CAST(o_custkey AS VARCHAR) AS phone, min(o_orderdate) AS first_order,
        max(o_orderdate) AS last_order, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS t, CAST(count(*) AS INTEGER) AS num_orders
        FROM ord GROUP BY branch, c_name, o_custkey""",
    "buyers": """SELECT branch, customer, phone, first_order, last_order, t AS total, num_orders FROM buyers0""",
    "active": "SELECT * FROM buyers WHERE total <> 0",
    "limits": """SELECT branch, quantile_cont(total, 0.33) AS q33, quantile_cont(total, 0.66) AS q66, quantile_cont(total, 0.5) AS median
        FROM active GROUP BY branch""",
    "shift0": """SELECT CAST(user_id AS VARCHAR) AS emp_id, 'Person_' || user_id AS name, 'store_' || (user_id % 5) AS branch,
        CAST(ts AS DATE) AS date, ts, date_trunc('second', ts) + to_seconds(CAST(floor(value / 10.0 * 3600) AS BIGINT)) AS te, value / 10.0 AS h
        FROM events WHERE event_type <> 'purchase'""",
    "shifts": """SELECT emp_id, name, branch, date, strftime(ts, '%H:%M:%S') AS punch_in, strftime(te, '%H:%M:%S') AS punch_out, h,
        round(h, 2) AS duration_hours, CAST(hour(ts) AS INTEGER) AS shift_start_hour,
        CASE WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' ELSE 'evening' END AS shift_type,
        h < 2 OR h > 14 AS is_anomalous, NOT (h < 2 OR h > 14) AS is_valid_shift, dayname(date) AS day_of_week,
        dayname(date) IN ('Saturday', 'Sunday') AS weekend_flag FROM shift0""",
    "spans": """SELECT branch, emp_id, date AS shift_date, date + CAST(punch_in AS TIME) AS s,
        date + CAST(punch_out AS TIME) + CASE WHEN punch_out < punch_in THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS e
        FROM shifts WHERE is_valid_shift""",
    "slots": """SELECT DISTINCT branch, CAST(x AS DATE) AS date, CAST(hour(x) AS INTEGER) AS hour, emp_id, shift_date FROM (
        SELECT branch, emp_id, shift_date, unnest(generate_series(date_trunc('hour', s), e - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS x FROM spans)""",
    "hourly": """SELECT branch, date, dayname(date) AS day_of_week, hour, count(DISTINCT emp_id) AS active_employees, count(*) AS active_shift_rows
        FROM slots GROUP BY ALL""",
    "profile": """SELECT branch, day_of_week, hour, round(avg(active_employees), 2) AS avg_active_employees,
        CAST(median(active_employees) AS DOUBLE) AS median_active_employees, min(active_employees) AS min_active_employees,
        max(active_employees) AS max_active_employees, count(*) AS slot_observations, count(DISTINCT date) AS observed_days
        FROM hourly GROUP BY ALL""",
    "deliv": """SELECT 'store_' || (user_id % 5) AS branch, CAST(user_id AS VARCHAR) AS customer, CAST(ts AS DATE) AS day, max(ts) AS last_order,
        CAST(count(*) AS INTEGER) AS num_orders FROM events WHERE event_type = 'purchase' GROUP BY ALL""",
    "win": "SELECT min(date) AS a, max(date) + INTERVAL 1 DAY AS b FROM shifts WHERE is_valid_shift",
    "near": "SELECT d.* FROM deliv d CROSS JOIN win WHERE last_order >= a AND last_order < b",
    "smenu0": """SELECT 'store_' || (user_id % 5) AS branch, CASE WHEN event_type = 'purchase' THEN 'DELIVERY' ELSE upper(event_type) END AS channel,
        CAST(count(*) AS DOUBLE) AS customers, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sales
        FROM events GROUP BY ALL""",
    "smenu": """SELECT *, round(customers / sum(customers) OVER (PARTITION BY branch), 6) AS share FROM smenu0""",
    "sweek": """SELECT 'store_' || (user_id % 5) AS branch, CAST(date_trunc('week', ts) AS DATE) AS date,
        CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM events GROUP BY ALL""",
    "shape0": """SELECT b.branch, b.day_of_week, b.hour, coalesce(n, 0) AS support_rows, coalesce(o, 0.0)::DOUBLE AS slot_num_orders,
        coalesce(bn, 0) AS branch_total_customer_rows_in_overlap, coalesce(bo, 0.0)::DOUBLE AS branch_total_num_orders_in_overlap,
        count(*) OVER (PARTITION BY b.branch) AS branch_staffed_slot_count
        FROM profile b
        LEFT JOIN (SELECT branch, dayname(last_order) AS day_of_week, CAST(hour(last_order) AS INTEGER) AS hour, count(*) AS n, sum(num_orders) AS o
            FROM near GROUP BY ALL) s USING (branch, day_of_week, hour)
        LEFT JOIN (SELECT branch, count(*) AS bn, sum(num_orders) AS bo FROM near GROUP BY branch) t USING (branch)""",
    "shape1": """SELECT *, CASE WHEN branch_total_customer_rows_in_overlap > 0
        THEN least(1.0::DOUBLE, branch_total_customer_rows_in_overlap / 12.0::DOUBLE) ELSE 0.0::DOUBLE END AS st,
        1.0::DOUBLE / branch_staffed_slot_count AS u FROM shape0""",
    "shape2": """SELECT *, CASE WHEN branch_total_customer_rows_in_overlap > 0 THEN
            CASE WHEN st < 1 THEN least(st * (support_rows::DOUBLE / branch_total_customer_rows_in_overlap) + (1 - st) * u, u * 4.0::DOUBLE)
            ELSE st * (support_rows::DOUBLE / branch_total_customer_rows_in_overlap) + (1 - st) * u END ELSE 0.0::DOUBLE END AS w FROM shape1""",
    "shape": """SELECT *, CASE WHEN sw > 0 THEN w / sw ELSE w END AS sh FROM (
        SELECT *, CAST(sum(CAST(w AS DECIMAL(20,15))) OVER (PARTITION BY branch) AS DOUBLE) AS sw FROM shape2)""",
    "mult0": """SELECT br.branch, coalesce(tc, 0.0)::DOUBLE AS tc, coalesce(dc, 0.0)::DOUBLE AS dc, coalesce(ds, 0.0)::DOUBLE AS ds, coalesce(np, 0) AS np,
        coalesce(no, 0.0)::DOUBLE AS no, coalesce(oo, 0.0)::DOUBLE AS oo, rm, coalesce(rr, 0.0)::DOUBLE AS rr
        FROM (SELECT DISTINCT branch FROM shifts WHERE is_valid_shift) br
        LEFT JOIN (SELECT branch, sum(customers) AS tc, max(CASE WHEN channel = 'DELIVERY' THEN customers END) AS dc,
            max(CASE WHEN channel = 'DELIVERY' THEN share END) AS ds FROM smenu GROUP BY branch) m USING (branch)
        LEFT JOIN (SELECT branch, count(*) AS np, sum(num_orders) AS no FROM deliv GROUP BY branch) p USING (branch)
        LEFT JOIN (SELECT branch, sum(num_orders) AS oo FROM near GROUP BY branch) w USING (branch)
        LEFT JOIN (SELECT branch, max(date) AS rm, max_by(revenue, date) AS rr FROM sweek GROUP BY branch) r USING (branch)""",
    "mult1": """SELECT *, CASE WHEN tc > 0 THEN greatest(0.005::DOUBLE, least(0.20::DOUBLE, np / tc)) END AS ps,
        (SELECT greatest(0.005::DOUBLE, least(0.20::DOUBLE, coalesce(median(CASE WHEN ds > 0 THEN ds END), 0.005::DOUBLE))) FROM mult0) AS gs,
        (SELECT CAST(sum(CAST(rr AS DECIMAL(18,2))) AS DOUBLE) FROM mult0) AS tr, (SELECT sum(oo) FROM mult0) AS tot FROM mult0""",
    "mult2": """SELECT *, CASE WHEN ds > 0 THEN greatest(0.005::DOUBLE, least(0.20::DOUBLE, ds)) WHEN ps > 0 THEN ps ELSE gs END AS base,
        CASE WHEN ds > 0 AND ps > 0 AND abs(ps - greatest(0.005::DOUBLE, least(0.20::DOUBLE, ds))) / greatest(0.005::DOUBLE, least(0.20::DOUBLE, ds)) > 1 THEN 'medium'
            WHEN ds > 0 THEN 'high' ELSE 'low' END AS confidence,
        CASE WHEN ds > 0 THEN 'avg_sales_menu_delivery_share' WHEN ps > 0 THEN 'customer_orders_profile_share'
            ELSE 'global_delivery_share_fallback' END AS share_source,
        CASE WHEN tr > 0 THEN rr / tr ELSE 0.0::DOUBLE END AS rs, CASE WHEN tot > 0 THEN oo / tot ELSE 0.0::DOUBLE END AS xs FROM mult1""",
    "mult3": """SELECT *, CASE WHEN xs > 0 THEN rs / xs ELSE 1.0::DOUBLE END AS gap,
        CASE confidence WHEN 'high' THEN 0.20::DOUBLE WHEN 'medium' THEN 0.35::DOUBLE ELSE 0.50::DOUBLE END AS spread FROM mult2""",
    "mult4": """SELECT *, greatest(0.005::DOUBLE, least(0.20::DOUBLE, base * (1 - spread))) AS lo, greatest(0.005::DOUBLE, least(0.20::DOUBLE, base * (1 + spread))) AS hi,
        CASE WHEN confidence = 'low' AND rs > 0 AND xs > 0 THEN least(3.5::DOUBLE, greatest(1.0::DOUBLE, sqrt(gap)))
            WHEN confidence = 'low' AND rs > 0 THEN 3.5::DOUBLE ELSE 1.0::DOUBLE END AS up FROM mult3""",
    "mult": """SELECT branch, tc AS avg_sales_total_customers, dc AS avg_sales_delivery_customers, ds AS avg_sales_delivery_share, np AS delivery_customer_profiles,
        no AS delivery_num_orders, round(ps, 8) AS observed_profile_share, share_source, confidence,
        concat_ws('; ', CASE WHEN confidence = 'medium' THEN 'avg_sales_menu and customer_orders profile counts disagree'
            WHEN share_source = 'customer_orders_profile_share' THEN 'delivery share inferred because avg_sales_menu has no delivery row'
            WHEN share_source = 'global_delivery_share_fallback' THEN 'delivery share inferred from global fallback' END,
            CASE WHEN confidence = 'low' AND rs > 0 AND xs = 0 THEN 'max sales uplift applied because proxy demand is missing'
            WHEN confidence = 'low' AND rs > 0 AND up > 1 THEN 'sales uplift applied for underrepresented proxy demand' END) AS note,
        rm AS recent_revenue_month, rr AS recent_revenue, round(rs, 6) AS recent_revenue_share_staffed_branches,
        round(xs, 6) AS overlap_proxy_order_share, round(gap, 4) AS sales_to_proxy_gap_ratio, round(up, 4) AS sales_calibration_multiplier,
        round(lo, 6) AS delivery_share_low, round(base, 6) AS delivery_share_base, round(hi, 6) AS delivery_share_high,
        round(1 / hi * up, 4) AS multiplier_low_demand, round(1 / base * up, 4) AS multiplier_base_demand,
        round(1 / lo * up, 4) AS multiplier_high_demand FROM mult4""",
    "demand": """SELECT branch, day_of_week, hour, confidence, round(branch_total_num_orders_in_overlap * sh, 4) AS delivery_orders_est,
        round(branch_total_num_orders_in_overlap * sh * multiplier_low_demand, 4) AS total_orders_est_low,
        round(branch_total_num_orders_in_overlap * sh * multiplier_base_demand, 4) AS total_orders_est_base,
        round(branch_total_num_orders_in_overlap * sh * multiplier_high_demand, 4) AS total_orders_est_high
        FROM shape LEFT JOIN mult USING (branch)""",
    "heads0": """SELECT p.branch, p.hour, CASE WHEN avg_active_employees > 0 THEN coalesce(total_orders_est_base, 0) / avg_active_employees ELSE 0.0::DOUBLE END AS v,
        CASE WHEN p.hour BETWEEN 6 AND 11 THEN 'morning' WHEN p.hour BETWEEN 12 AND 16 THEN 'afternoon' WHEN p.hour BETWEEN 17 AND 23 THEN 'evening'
            ELSE 'overnight' END AS sb FROM profile p LEFT JOIN demand d USING (branch, day_of_week, hour)""",
    "heads": """SELECT branch, sb, 'branch_shift' AS lv, v FROM heads0 UNION ALL SELECT branch, 'all_day', 'branch_all_day', v FROM heads0
        UNION ALL SELECT '__global__', 'all_day', 'global', v FROM heads0""",
    "fence": """SELECT branch, sb, lv, count(CASE WHEN v > 0 THEN 1 END) AS slot_count, median(v) AS med,
        quantile_cont(CASE WHEN v > 0 THEN v END, 0.25) AS q1, quantile_cont(CASE WHEN v > 0 THEN v END, 0.75) AS q3 FROM heads GROUP BY ALL""",
    "mid": """SELECT h.branch, h.sb, h.lv, median(v) AS m FROM heads h JOIN fence f ON h.branch = f.branch AND h.sb = f.sb AND h.lv = f.lv
        WHERE v > 0 AND v >= greatest(0.0::DOUBLE, q1 - 1.5::DOUBLE * (q3 - q1)) AND v <= q3 + 1.5::DOUBLE * (q3 - q1) GROUP BY ALL""",
    "targ0": """SELECT f.*, greatest(coalesce(m, 0.25::DOUBLE), 0.25::DOUBLE) AS t, confidence FROM fence f LEFT JOIN mid USING (branch, sb, lv)
        LEFT JOIN mult USING (branch)""",
    "targ": """SELECT branch, sb AS shift_bucket, slot_count, round(coalesce(med, 0), 4) AS median_observed_orders_per_employee,
        round(CASE WHEN lv <> 'global' AND slot_count = 0 THEN NULL WHEN lv <> 'global' AND confidence = 'low' AND slot_count < 8 THEN NULL
            WHEN lv <> 'global' AND confidence = 'low' THEN least(t, (SELECT max(t) FROM targ0 WHERE lv = 'global') * 1.5::DOUBLE) ELSE t END, 4)
            AS target_orders_per_employee, lv AS reference_level, confidence FROM targ0""",
    "gap0": """SELECT p.*, d.delivery_orders_est, d.total_orders_est_low, d.total_orders_est_base, d.total_orders_est_high,
        CASE WHEN p.hour BETWEEN 6 AND 11 THEN 'morning' WHEN p.hour BETWEEN 12 AND 16 THEN 'afternoon' WHEN p.hour BETWEEN 17 AND 23 THEN 'evening'
            ELSE 'overnight' END AS shift_bucket FROM profile p LEFT JOIN demand d USING (branch, day_of_week, hour)""",
    "gap1": """SELECT g.*, round(coalesce(s.target_orders_per_employee, b.target_orders_per_employee,
            (SELECT max(target_orders_per_employee) FROM targ WHERE reference_level = 'global')), 4) AS target_orders_per_employee
        FROM gap0 g LEFT JOIN targ s ON s.reference_level = 'branch_shift' AND s.branch = g.branch AND s.shift_bucket = g.shift_bucket
        LEFT JOIN targ b ON b.reference_level = 'branch_all_day' AND b.branch = g.branch""",
    "gap2": """SELECT *, """ + ", ".join(
        f"""CAST(greatest(1, CASE WHEN total_orders_est_{c} > 0 AND target_orders_per_employee > 0
            THEN ceil(total_orders_est_{c} / target_orders_per_employee) ELSE 0 END) AS INTEGER) AS required_employees_{c}"""
        for c in ("low", "base", "high")) + " FROM gap1",
    "gap3": "SELECT *, " + ", ".join(f"round(required_employees_{c} - avg_active_employees, 2) AS gap_{c}" for c in ("low", "base", "high")) + " FROM gap2",
    "gaps": """SELECT *, CASE WHEN gap_base >= 1.0 THEN 'understaffed' WHEN gap_base <= -1.0 THEN 'overstaffed' ELSE 'balanced' END AS status,
        list_position(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], day_of_week) AS dn FROM gap3""",
    "under_slots": """SELECT *, row_number() OVER (PARTITION BY branch ORDER BY gap_base DESC, dn, hour) AS rn FROM gaps WHERE status = 'understaffed'""",
    "over_slots": """SELECT *, row_number() OVER (PARTITION BY branch ORDER BY gap_base, dn, hour) AS rn FROM gaps WHERE status = 'overstaffed'""",
    "found": """SELECT g.branch, confidence AS demand_confidence, share_source, analysis_slots, understaffed_slots, balanced_slots, overstaffed_slots,
        avg_active_employees_across_slots, avg_required_employees_base, coalesce(us, '') AS worst_understaffed_slot, coalesce(ug, 0.0::DOUBLE) AS worst_understaffed_gap,
        coalesce(os, '') AS worst_overstaffed_slot, coalesce(og, 0.0::DOUBLE) AS worst_overstaffed_gap, coalesce(ul, '') AS top_understaffed_slots,
        coalesce(ol, '') AS top_overstaffed_slots,
        CASE WHEN understaffed_slots > 0 THEN 'Increase staffing around the highest-gap slots before widening other shifts.'
            WHEN overstaffed_slots > 0 THEN 'Trim low-demand slots or reassign employees to busier periods.'
            ELSE 'Current staffing looks balanced under the base-demand scenario.' END AS recommendation
        FROM (SELECT branch, count(*) AS analysis_slots, count(*) FILTER (WHERE status = 'understaffed') AS understaffed_slots,
                count(*) FILTER (WHERE status = 'balanced') AS balanced_slots, count(*) FILTER (WHERE status = 'overstaffed') AS overstaffed_slots,
                round(avg(avg_active_employees), 2) AS avg_active_employees_across_slots,
                round(avg(required_employees_base), 2) AS avg_required_employees_base FROM gaps GROUP BY branch) g
        LEFT JOIN mult USING (branch)
        LEFT JOIN (SELECT branch, max(CASE WHEN rn = 1 THEN format('{} {:02d}:00', day_of_week, hour) END) AS us, max(CASE WHEN rn = 1 THEN gap_base END) AS ug,
            string_agg(format('{} {:02d}:00 (gap {:.2f})', day_of_week, hour, gap_base), '; ' ORDER BY rn) AS ul FROM under_slots WHERE rn <= 3 GROUP BY branch) u USING (branch)
        LEFT JOIN (SELECT branch, max(CASE WHEN rn = 1 THEN format('{} {:02d}:00', day_of_week, hour) END) AS os, max(CASE WHEN rn = 1 THEN gap_base END) AS og,
            string_agg(format('{} {:02d}:00 (gap {:.2f})', day_of_week, hour, gap_base), '; ' ORDER BY rn) AS ol FROM over_slots WHERE rn <= 3 GROUP BY branch) o USING (branch)""",
    "gb": """SELECT branch, order_id, items FROM bask""",
    "gi": """SELECT DISTINCT branch, order_id, item, (regexp_matches(' ' || item || ' ', '(^|[\\s\\-])(hot|cold)([\\s\\-]|$)')
        AND NOT regexp_matches(item, '\\banvil\\b')) AS target FROM line""",
    "kpi": """SELECT branch, total_orders, beverage_orders, beverage_attachment_rate, max(beverage_attachment_rate) OVER () AS best_branch_rate,
        round(max(beverage_attachment_rate) OVER () - beverage_attachment_rate, 4) AS beverage_gap_to_best FROM (
        SELECT branch, count(DISTINCT order_id) AS total_orders, count(DISTINCT CASE WHEN target THEN order_id END) AS beverage_orders,
        round(count(DISTINCT CASE WHEN target THEN order_id END)::DOUBLE / count(DISTINCT order_id), 4) AS beverage_attachment_rate
        FROM gi GROUP BY branch)""",
    "rev": """SELECT branch, total_amount, bev_amount, round(bev_amount / total_amount, 4) AS bev_revenue_share FROM (
        SELECT branch, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount,
        CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE regexp_matches(' ' || item || ' ', '(^|[\\s\\-])(hot|cold)([\\s\\-]|$)')
            AND NOT regexp_matches(item, '\\banvil\\b')), 0) AS DOUBLE) AS bev_amount FROM item0 GROUP BY branch)""",
    "gs": """SELECT branch, false AS is_total, order_id, item, target FROM gi UNION ALL SELECT 'ALL', true, order_id, item, target FROM gi""",
    "gn": "SELECT branch, is_total, count(DISTINCT order_id) AS nb FROM gs GROUP BY ALL",
    "gc": "SELECT branch, is_total, item, count(*) AS n FROM gs GROUP BY ALL",
    "rules0": """SELECT p.branch, p.is_total, p.antecedents, p.consequents, ab, a.n AS na, b.n AS nc, nb FROM (
            SELECT x.branch, x.is_total, x.item AS antecedents, y.item AS consequents, count(*) AS ab
            FROM gs x JOIN gs y ON x.branch = y.branch AND x.is_total = y.is_total AND x.order_id = y.order_id AND NOT x.target AND y.target GROUP BY ALL) p
        JOIN gn ON gn.branch = p.branch AND gn.is_total = p.is_total
        JOIN gc a ON a.branch = p.branch AND a.is_total = p.is_total AND a.item = p.antecedents
        JOIN gc b ON b.branch = p.branch AND b.is_total = p.is_total AND b.item = p.consequents""",
    "rules": """SELECT branch, is_total, antecedents, consequents, round(ab::DOUBLE / nb, 5) AS support, round(ab::DOUBLE / na, 4) AS confidence,
        round((ab::DOUBLE / na) / (nc::DOUBLE / nb), 4) AS lift FROM rules0""",
    "rules1": """SELECT p.branch, p.is_total, p.antecedents, p.consequents, ab, a.n AS na, b.n AS nc, nb FROM (
            SELECT x.branch, x.is_total, x.item AS antecedents, y.item AS consequents, count(*) AS ab
            FROM gs x JOIN gs y ON x.branch = y.branch AND x.is_total = y.is_total AND x.order_id = y.order_id AND x.item <> y.item AND y.target GROUP BY ALL) p
        JOIN gn ON gn.branch = p.branch AND gn.is_total = p.is_total
        JOIN gc a ON a.branch = p.branch AND a.is_total = p.is_total AND a.item = p.antecedents
        JOIN gc b ON b.branch = p.branch AND b.is_total = p.is_total AND b.item = p.consequents""",
    "top_rules": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY branch, is_total ORDER BY lift DESC, confidence DESC, antecedents, consequents) AS rn
        FROM rules) WHERE rn <= 10""",
    "pot0": """SELECT k.*, total_amount, bev_amount, bev_revenue_share, coalesce(avg_lift, 0) AS avg_lift0, coalesce(top_bundle_rule, '') AS top_bundle_rule
        FROM kpi k LEFT JOIN rev USING (branch) LEFT JOIN (SELECT branch, avg(lift) AS avg_lift,
            max(CASE WHEN rn = 1 THEN antecedents || ' → ' || consequents || ' (lift=' || format('{:.2f}', lift) || ')' END) AS top_bundle_rule
            FROM top_rules WHERE NOT is_total AND rn <= 5 GROUP BY branch) r USING (branch)""",
    "pot1": """SELECT *, """ + ", ".join(
        f"coalesce(CASE WHEN max({e}) OVER () > min({e}) OVER () THEN (({e}) - min({e}) OVER ()) / (max({e}) OVER () - min({e}) OVER ()) END, 0.5::DOUBLE) AS {n}"
        for n, e in (("s1", "1 - beverage_attachment_rate"), ("s2", "total_orders::DOUBLE"), ("s3", "avg_lift0"))) + " FROM pot0",
    "pot": """SELECT *, round(0.35::DOUBLE * s1 + 0.35::DOUBLE * s2 + 0.30::DOUBLE * s3, 4) AS potential_score FROM pot1""",
    "rk0": """SELECT branch, date, revenue, row_number() OVER (PARTITION BY branch ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY branch) AS n FROM months""",
    "rk": """SELECT branch, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_monthly_revenue,
        covar_samp(i::DOUBLE / greatest(n - 1, 1), revenue) / var_pop(i::DOUBLE / greatest(n - 1, 1)) / avg(revenue) AS recent_growth_rate,
        stddev_samp(revenue) / avg(revenue) AS revenue_volatility,
        (max_by(revenue, date) - min_by(revenue, date)) / abs(min_by(revenue, date)) AS pct_change_first_last, count(*) AS n_months,
        count(*) < 12 AS is_partial_history FROM rk0 GROUP BY branch""",
    "ok": """SELECT branch, sum(num_orders) AS orders_count, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS total_customer_revenue FROM buyers GROUP BY branch""",
    "dk": """SELECT branch, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS delivery_revenue, count(DISTINCT c_name) AS delivery_order_count
        FROM ord WHERE channel = 'DELIVERY' GROUP BY branch""",
    "hk": """SELECT CASE branch WHEN 'store_0' THEN 'AFRICA' WHEN 'store_1' THEN 'AMERICA' WHEN 'store_2' THEN 'ASIA' WHEN 'store_3' THEN 'EUROPE'
        ELSE 'MIDDLE EAST' END AS branch, CAST(sum(CAST(h AS DECIMAL(18,4))) AS DOUBLE) AS total_hours FROM shift0 GROUP BY ALL""",
    "tk": """SELECT branch, CAST(sum(CAST(o_totalprice * 0.11::DOUBLE AS DECIMAL(18,2))) AS DOUBLE) AS total_tax FROM ord GROUP BY branch""",
    "bk": """SELECT rk.*, orders_count, total_customer_revenue / orders_count AS avg_order_value, total_customer_revenue, delivery_revenue, delivery_order_count,
        least(greatest(delivery_revenue / (avg_monthly_revenue * n_months), 0), 1) AS delivery_share,
        avg_monthly_revenue * n_months / total_hours AS revenue_per_hour, total_tax / (avg_monthly_revenue * n_months) AS tax_burden
        FROM rk LEFT JOIN ok USING (branch) LEFT JOIN dk USING (branch) LEFT JOIN hk USING (branch)
        LEFT JOIN tk USING (branch)""",
    "fs0": """SELECT branch, avg_monthly_revenue, recent_growth_rate, revenue_volatility, coalesce(avg_order_value, median(avg_order_value) OVER (), 0.5) AS avg_order_value,
        coalesce(delivery_share, median(delivery_share) OVER (), 0.5) AS delivery_share,
        coalesce(revenue_per_hour, median(revenue_per_hour) OVER (), 0.5) AS revenue_per_hour FROM bk""",
    "fs1": "SELECT *, " + ", ".join(
        f"coalesce(CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 0.5::DOUBLE) AS {n}"
        for c, n in (("recent_growth_rate", "norm_growth"), ("avg_monthly_revenue", "norm_revenue"), ("revenue_volatility", "norm_volatility"),
                     ("avg_order_value", "norm_avg_order"), ("delivery_share", "norm_delivery"), ("revenue_per_hour", "norm_ops_eff"))) + " FROM fs0",
    "fs2": """SELECT *, 1 - norm_volatility AS stability, round(norm_growth * 0.30::DOUBLE + norm_revenue * 0.25::DOUBLE + (1 - norm_volatility) * 0.15::DOUBLE
        + norm_avg_order * 0.15::DOUBLE + norm_delivery * 0.10::DOUBLE + norm_ops_eff * 0.05::DOUBLE, 4) AS feasibility_score FROM fs1""",
    "drv": """SELECT branch, string_agg(name, ', ' ORDER BY v DESC, i) AS top_drivers FROM (
        SELECT branch, name, v, i, row_number() OVER (PARTITION BY branch ORDER BY v DESC, i) AS rn FROM (
            SELECT branch, 'growth' AS name, norm_growth * 0.30::DOUBLE AS v, 1 AS i FROM fs2 UNION ALL SELECT branch, 'revenue', norm_revenue * 0.25::DOUBLE, 2 FROM fs2
            UNION ALL SELECT branch, 'stability', stability * 0.15::DOUBLE, 3 FROM fs2 UNION ALL SELECT branch, 'avg_order', norm_avg_order * 0.15::DOUBLE, 4 FROM fs2
            UNION ALL SELECT branch, 'delivery', norm_delivery * 0.10::DOUBLE, 5 FROM fs2 UNION ALL SELECT branch, 'ops_eff', norm_ops_eff * 0.05::DOUBLE, 6 FROM fs2))
        WHERE rn <= 2 GROUP BY branch""",
    "fs": """SELECT *, CASE WHEN feasibility_score >= 0.65 THEN 'High' WHEN feasibility_score >= 0.45 THEN 'Medium' ELSE 'Low' END AS score_tier,
        CASE branch WHEN 'AFRICA' THEN 'south' WHEN 'AMERICA' THEN 'west' WHEN 'EUROPE' THEN 'north' ELSE 'east' END AS region
        FROM fs2 JOIN drv USING (branch)""",
    "rs": "SELECT region, round(avg(feasibility_score), 4) AS region_score FROM fs GROUP BY region",
    "an0": """SELECT branch, date, 12 * year(date) + month(date) - 1 AS t, revenue AS y, (revenue - lag(revenue) OVER w) / lag(revenue) OVER w AS g
        FROM months WINDOW w AS (PARTITION BY branch ORDER BY date)""",
    "an": """SELECT *, CASE WHEN g <= -0.8 THEN 'likely_partial_month' WHEN g >= 0.15 AND month(date) = 3 THEN 'potential_surge'
            WHEN g >= 0.10 AND branch = 'ASIA' THEN 'potential_spike' END AS anomaly,
        CASE WHEN g <= -0.8 THEN 0.0::DOUBLE WHEN g >= 0.15 AND month(date) = 3 THEN 0.5::DOUBLE WHEN g >= 0.10 AND branch = 'ASIA' THEN 0.5::DOUBLE
            ELSE 1.0::DOUBLE END AS weight FROM an0""",
    "sc": """SELECT branch, 'base' AS scenario, date, t, y, 1.0::DOUBLE AS w FROM an WHERE anomaly IS NULL
        UNION ALL SELECT branch, 'surge_sensitive', date, t, y, weight FROM an WHERE weight > 0""",
    "es0": """SELECT *, row_number() OVER (PARTITION BY branch, scenario ORDER BY t DESC) AS age, (y - lag(y) OVER s) / lag(y) OVER s AS g,
        t - min(t) OVER (PARTITION BY branch) AS x FROM sc WINDOW s AS (PARTITION BY branch, scenario ORDER BY t)""",
    "es1": """SELECT branch, scenario, count(*) AS n, max(t) AS st, max(t - x) AS t0, max(CASE WHEN age = 1 THEN y END) AS naive, max(CASE WHEN age = 2 THEN y END) AS prev,
        max(CASE WHEN age = 1 THEN y END) AS y1, max(CASE WHEN age = 2 THEN y END) AS y2, max(CASE WHEN age = 3 THEN y END) AS y3,
        coalesce(stddev_samp(g), 0) AS vs, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * y) AS sxy, sum(w * x * x) AS sxx
        FROM es0 GROUP BY ALL""",
    "es": """SELECT *, CASE WHEN n >= 3 THEN (0.5::DOUBLE * y3 + 0.3::DOUBLE * y2 + 0.2::DOUBLE * y1) WHEN n = 2 THEN (0.5::DOUBLE * y2 + 0.3::DOUBLE * y1) / 0.8::DOUBLE ELSE y1 END AS wma3,
        CASE WHEN n >= 3 THEN (sxy - sw * mx * my) / (sxx - sw * mx * mx) END AS slope FROM es1""",
    "fct": """SELECT branch, max(t) AS lt, max_by(t, t) FILTER (WHERE anomaly IS NULL) AS ct, max_by(y, t) FILTER (WHERE anomaly IS NULL) AS cy,
        count(anomaly) AS nf, round(stddev_samp(g), 4) AS vf, max(CASE WHEN month(date) = 12 AND anomaly IS NOT NULL THEN anomaly END) AS dec
        FROM an GROUP BY branch""",
    "en0": """SELECT e.branch, e.scenario, p, n, naive, wma3, lt, ct, cy, nf, coalesce(greatest(0.0::DOUBLE, slope * (st + p) + (my - slope * (mx + t0))), naive) AS linear,
        CASE WHEN e.scenario <> 'base' AND vf > 0 THEN vf ELSE b.vb END AS vol, coalesce(dec, 'none') AS dec
        FROM es e JOIN fct USING (branch) JOIN (SELECT branch, vs AS vb FROM es WHERE scenario = 'base') b USING (branch), (VALUES (1), (2), (3)) AS h(p)""",
    "en1": "SELECT *, list_sort([naive, wma3, linear]) AS v, least(vol, 0.75::DOUBLE) AS cap FROM en0",
    "en2": """SELECT *, v[2] AS val, greatest(0.0::DOUBLE, (v[1] + 0.5::DOUBLE * (v[2] - v[1])) * (1 - cap)) AS lo, (v[2] + 0.5::DOUBLE * (v[3] - v[2])) * (1 + cap) AS hi,
        CASE WHEN v[2] > 0 THEN (v[3] - v[1]) / v[2] ELSE 0 END AS dis FROM en1""",
    "en3": """SELECT *, least(25, greatest(0, trunc((n - 2) * 25 / 3.0)))::INTEGER AS sq, greatest(0, trunc(25 * (1 - vol / 1.5::DOUBLE)))::INTEGER AS sv,
        greatest(0, trunc(25 * (1 - least(dis, 1.0::DOUBLE))))::INTEGER AS sa, CASE WHEN nf > 0 THEN 10 ELSE 25 END AS sn FROM en2""",
    # First words of part names as items, by branch (w) and by customer (c); sets of any size by recursion over each basket.
    "wi": """SELECT DISTINCT branch, order_id, split_part(item, ' ', 1) AS item, split_part(item, ' ', 1) IN ('hot', 'cold') AS target FROM line""",
    "ci": """SELECT DISTINCT c_name AS branch, CAST(l_orderkey AS VARCHAR) AS order_id, split_part(p_name, ' ', 1) AS item, split_part(p_name, ' ', 1) IN ('hot', 'cold') AS target
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN ord ON l_orderkey = o_orderkey""",
    **{name: sql for x, support, confidence in (("w", 0.02, 0.05), ("c", 0.3, 0.5)) for name, sql in {
        f"{x}g": f"SELECT branch, false AS is_total, order_id, item, target FROM {x}i UNION ALL SELECT 'ALL', true, order_id, item, target FROM {x}i",
        f"{x}nb": f"SELECT branch, is_total, count(DISTINCT order_id) AS nb FROM {x}g GROUP BY ALL",
        f"{x}sub": f"""WITH RECURSIVE rec AS (SELECT branch, is_total, order_id, [item] AS items, item AS last FROM {x}g
            UNION ALL SELECT r.branch, r.is_total, r.order_id, list_append(r.items, g.item), g.item FROM rec r
            JOIN {x}g g ON g.branch = r.branch AND g.is_total = r.is_total AND g.order_id = r.order_id AND g.item > r.last)
            SELECT branch, is_total, items, count(*) AS n FROM rec GROUP BY ALL""",
        f"{x}freq": f"SELECT s.*, nb FROM {x}sub s JOIN {x}nb USING (branch, is_total) WHERE nb >= 5 AND n::DOUBLE / nb >= {support}::DOUBLE",
        f"{x}rules": f"""SELECT s.branch, s.is_total, array_to_string(a.items, ', ') AS antecedents, array_to_string(c.items, ', ') AS consequents, s.n::DOUBLE / s.nb AS support,
            s.n::DOUBLE / a.n AS confidence, (s.n::DOUBLE / a.n) / (c.n::DOUBLE / c.nb) AS lift FROM {x}freq s
            JOIN {x}freq c ON c.branch = s.branch AND c.is_total = s.is_total AND len(c.items) < len(s.items) AND list_has_all(s.items, c.items)
                AND list_has_all(['hot', 'cold'], c.items)
            JOIN {x}freq a ON a.branch = s.branch AND a.is_total = s.is_total AND a.items = list_filter(s.items, lambda i: NOT list_contains(c.items, i))
            WHERE s.n::DOUBLE / a.n >= {confidence}::DOUBLE""",
    }.items()},
    "cc": "SELECT branch, is_total, item, count(*) AS n FROM cg GROUP BY ALL",
    "cpairs": """SELECT p.branch, p.is_total, p.antecedents, p.consequents, round(ab::DOUBLE / nb, 5) AS support, round(ab::DOUBLE / a.n, 4) AS confidence,
        round((ab::DOUBLE / a.n) / (b.n::DOUBLE / nb), 4) AS lift FROM (
            SELECT x.branch, x.is_total, x.item AS antecedents, y.item AS consequents, count(*) AS ab
            FROM cg x JOIN cg y ON x.branch = y.branch AND x.is_total = y.is_total AND x.order_id = y.order_id AND NOT x.target AND y.target GROUP BY ALL) p
        JOIN cnb ON cnb.branch = p.branch AND cnb.is_total = p.is_total
        JOIN cc a ON a.branch = p.branch AND a.is_total = p.is_total AND a.item = p.antecedents
        JOIN cc b ON b.branch = p.branch AND b.is_total = p.is_total AND b.item = p.consequents""",
    # Quarters as series of their own.
    "qs0": """SELECT branch AS b, year(date) || 'Q' || quarter(date) AS q, 12 * year(date) + month(date) - 1 AS t, revenue AS y FROM months""",
    "qs1": """SELECT *, row_number() OVER (PARTITION BY b, q ORDER BY t DESC) AS age, (y - lag(y) OVER s) / lag(y) OVER s AS g, t - min(t) OVER (PARTITION BY b, q) AS x
        FROM qs0 WINDOW s AS (PARTITION BY b, q ORDER BY t)""",
    "qs2": """SELECT b, q, count(*) AS n, max(t) AS st, max(t - x) AS t0, max(CASE WHEN age = 1 THEN y END) AS y1, max(CASE WHEN age = 2 THEN y END) AS y2,
        max(CASE WHEN age = 3 THEN y END) AS y3, coalesce(stddev_samp(g), 0) AS vs, avg(x) AS mx, avg(y) AS my, sum(x * y) AS sxy, sum(x * x) AS sxx FROM qs1 GROUP BY b, q""",
    "qs": """SELECT *, b || ' ' || q AS k, y1 AS naive, CASE WHEN n >= 3 THEN 0.5::DOUBLE * y3 + 0.3::DOUBLE * y2 + 0.2::DOUBLE * y1 WHEN n = 2 THEN (0.5::DOUBLE * y2 + 0.3::DOUBLE * y1) / 0.8::DOUBLE
        ELSE y1 END AS wma3, CASE WHEN n >= 3 THEN (sxy - n * mx * my) / (sxx - n * mx * mx) END AS slope FROM qs2""",
    # Forecasts of all months from each of the last twelve origins, with the actual value.
    "bt0": """SELECT branch, 12 * year(date) + month(date) - 1 AS t, revenue AS y, row_number() OVER (PARTITION BY branch ORDER BY date DESC) AS age FROM months""",
    "bt1": """SELECT branch, o, t, y, row_number() OVER (PARTITION BY branch, o ORDER BY t DESC) AS i, (y - lag(y) OVER s) / lag(y) OVER s AS g, t - min(t) OVER (PARTITION BY branch, o) AS x
        FROM bt0, (SELECT unnest(range(1, 13)) AS o) WHERE age > o WINDOW s AS (PARTITION BY branch, o ORDER BY t)""",
    "bt2": """SELECT branch, o, count(*) AS n, max(t) AS st, max(t - x) AS t0, max(CASE WHEN i = 1 THEN y END) AS y1, max(CASE WHEN i = 2 THEN y END) AS y2, max(CASE WHEN i = 3 THEN y END) AS y3,
        coalesce(stddev_samp(g), 0) AS vs, avg(x) AS mx, avg(y) AS my, sum(x * y) AS sxy, sum(x * x) AS sxx FROM bt1 GROUP BY branch, o""",
    "bt3": """SELECT *, y1 AS naive, 0.5::DOUBLE * y3 + 0.3::DOUBLE * y2 + 0.2::DOUBLE * y1 AS wma3, (sxy - n * mx * my) / (sxx - n * mx * mx) AS slope, least(vs, 0.75::DOUBLE) AS cap FROM bt2""",
    "bt4": """SELECT *, greatest(0.0::DOUBLE, slope * (st + p) + (my - slope * (mx + t0))) AS linear FROM bt3, (VALUES (1), (2), (3)) AS h(p)""",
    "bt5": "SELECT *, list_sort([naive, wma3, linear]) AS v FROM bt4",
    "bt": """SELECT bt5.branch, o, p, naive, wma3, linear, v[2] AS val, greatest(0.0::DOUBLE, (v[1] + 0.5::DOUBLE * (v[2] - v[1])) * (1 - cap)) AS lo,
        (v[2] + 0.5::DOUBLE * (v[3] - v[2])) * (1 + cap) AS hi, bt0.y FROM bt5 JOIN bt0 ON bt0.branch = bt5.branch AND bt0.age = o - p + 1""",
    "doc_lines": "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents",
}


def half_even(sql: str) -> str:
    """``round(x, n)`` as rounding half to even, the rule of the library; plain SQL rounds a half away from zero."""
    at = sql.rfind("round(")
    while at >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x, _, n = sql[at + 6:end - 1].rpartition(",")
        scaled = f"(({x}) * 1e{n.strip()})"
        even = f"(CASE WHEN abs{scaled} % 1 = 0.5 THEN 2 * ROUND({scaled} / 2) ELSE ROUND({scaled}) END / 1e{n.strip()})"
        sql = sql[:at] + even + sql[end:]
        at = sql.rfind("round(", 0, at)
    return sql


def with_parts(body: str) -> str:
    """The statement preceded by every part it uses, directly or through other parts."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+([a-z_0-9]+)", text)):
            if word in PARTS and word not in order and PARTS[word] is not text:
                visit(PARTS[word])
                if word not in order:
                    order.append(word)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name]})" for name in order) + "\n" + body


_METRICS = "item_a, item_b, count_ab, support, confidence_ab, confidence_ba, lift, n_orders"
_TOP = """SELECT rank, {by}, item_a, item_b, count_ab, support, confidence_ab, confidence_ba, lift, n_orders FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY count_ab DESC, item_a, item_b) AS INTEGER) AS rank
    FROM pairs WHERE scope_type = '{by}' AND count_ab >= {n}) WHERE rank <= 10"""

BODIES: dict[str, str] = {
    "pairs_overall": f"SELECT scope, scope_type, count_a, count_b, {_METRICS} FROM pairs WHERE scope_type = 'overall'",
    "pairs_four_scopes": f"SELECT scope, scope_type, branch, channel, count_a, count_b, {_METRICS} FROM pairs",
    "pairs_top_overall": f"SELECT {_METRICS} FROM pairs WHERE scope_type = 'overall' ORDER BY support0 DESC, count_ab DESC, item_a, item_b LIMIT 20",
    "pairs_top_per_branch": _TOP.format(by="branch", n=3),
    "pairs_top_per_channel": _TOP.format(by="channel", n=5),
    "pairs_with_item": f"""SELECT scope, CASE WHEN contains(upper(item_a), 'ANVIL') THEN item_b ELSE item_a END AS paired_with, {_METRICS} FROM pairs
        WHERE scope_type = 'overall' AND (contains(upper(item_a), 'ANVIL') OR contains(upper(item_b), 'ANVIL'))
        ORDER BY count_ab DESC, item_a, item_b LIMIT 25""",
    "pairs_similar_items": """SELECT DISTINCT item FROM (SELECT upper(item_a) AS item FROM pairs WHERE scope_type = 'overall'
        UNION ALL SELECT upper(item_b) FROM pairs WHERE scope_type = 'overall') WHERE contains(item, 'LARG') ORDER BY item LIMIT 5""",
    "pair_checks": """SELECT 'support_range' AS check_name, count(*) FILTER (WHERE NOT support0 BETWEEN 0 AND 1) AS violations FROM pairs
        UNION ALL SELECT 'confidence_ab_range', count(*) FILTER (WHERE NOT ab0 BETWEEN 0 AND 1) FROM pairs
        UNION ALL SELECT 'confidence_ba_range', count(*) FILTER (WHERE NOT ba0 BETWEEN 0 AND 1) FROM pairs
        UNION ALL SELECT 'count_ab_above_a', count(*) FILTER (WHERE count_ab > count_a) FROM pairs
        UNION ALL SELECT 'count_ab_above_b', count(*) FILTER (WHERE count_ab > count_b) FROM pairs
        UNION ALL SELECT 'pair_order', count(*) FILTER (WHERE item_a >= item_b) FROM pairs
        UNION ALL SELECT 'mirrored_pairs', count(*) FROM pairs x JOIN pairs y ON x.scope = y.scope AND x.item_a = y.item_b AND x.item_b = y.item_a
        UNION ALL SELECT 'pairs_per_basket', count(*) FILTER (WHERE made <> k * (k - 1) / 2) FROM (
            SELECT len(items) AS k, CASE WHEN len(items) >= 2 THEN list_sum(list_transform(range(1, len(items)), lambda i: len(items) - i)) ELSE 0 END AS made FROM bask)""",
    "order_baskets": """SELECT order_id, branch, channel, array_to_string(items, '|') AS items_set, CAST(len(items) AS INTEGER) AS n_items,
        CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(hour(ts) AS INTEGER) AS hour, CAST(month(ts) AS INTEGER) AS month FROM bask""",
    "channel_infer": """SELECT branch, CASE WHEN m THEN 'DELIVERY' ELSE 'IN_STORE' END AS channel, count(*) AS n_lines, count(DISTINCT order_id) AS n_orders FROM (
        SELECT *, bool_or(upper(item) = 'HOT ANVIL') OVER (PARTITION BY order_id) AS m FROM line) GROUP BY ALL""",
    "channel_kpis": """SELECT branch, channel, customers, sales, round(sales / customers, 4) AS avg_per_customer,
        round(sales / sum(sales) OVER (PARTITION BY branch), 6) AS sales_share_within_branch,
        round(customers / sum(customers) OVER (PARTITION BY branch), 6) AS customer_share_within_branch FROM menu""",
    "item_category": """SELECT category, is_modifier, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM (
        SELECT is_modifier, amount, CASE WHEN contains(item, 'cold') THEN 'coffee_cold' WHEN contains(item, 'hot') THEN 'coffee_hot'
            WHEN is_modifier THEN 'modifier' ELSE 'core_food' END AS category FROM items) GROUP BY ALL""",
    "item_shares_ranks": """SELECT branch, division, "group", item, qty, amount, is_modifier, category,
        CASE WHEN NOT is_modifier THEN round(amount / sum(CASE WHEN NOT is_modifier THEN CAST(amount AS DECIMAL(18,2)) END) OVER (PARTITION BY branch), 6) END AS item_sales_share_within_branch,
        CASE WHEN NOT is_modifier THEN CAST(dense_rank() OVER (PARTITION BY branch, is_modifier ORDER BY amount DESC) AS INTEGER) END AS item_rank_within_branch,
        CASE WHEN NOT is_modifier THEN CAST(dense_rank() OVER (PARTITION BY branch, division, is_modifier ORDER BY amount DESC) AS INTEGER) END AS item_rank_within_division
        FROM items""",
    "dim_branch": """SELECT branch AS canonical_branch_name, coalesce(bool_or(channel = 'DELIVERY'), false) AS has_delivery, coalesce(bool_or(channel = 'TABLE'), false) AS has_table,
        coalesce(bool_or(channel = 'TAKE AWAY'), false) AS has_takeaway, sum(m) > 0 AS has_monthly_sales, CAST(sum(m) AS BIGINT) AS months_of_data, sum(s) > 0 AS has_attendance_data FROM (
        SELECT branch, channel, 0 AS m, 0 AS s FROM menu UNION ALL SELECT branch, NULL, 1, 0 FROM months UNION ALL SELECT branch, NULL, 0, 1 FROM shift0) GROUP BY branch""",
    "dim_item": """SELECT item AS canonical_item_name, division, "group", category, modifier_flag, category IN ('coffee_hot', 'coffee_cold', 'milkshake', 'other_beverage') AS beverage_flag FROM (
        SELECT *, row_number() OVER (PARTITION BY item ORDER BY branch, division, "group") AS rn, bool_or(is_modifier) OVER (PARTITION BY item) AS modifier_flag FROM items) WHERE rn = 1""",
    "dim_item_beverages": """SELECT item AS canonical_item_name, division, "group", category, modifier_flag, category IN ('coffee_hot', 'coffee_cold', 'milkshake', 'other_beverage') AS beverage_flag FROM (
        SELECT *, row_number() OVER (PARTITION BY item ORDER BY branch, division, "group") AS rn, bool_or(is_modifier) OVER (PARTITION BY item) AS modifier_flag FROM drinks) WHERE rn = 1""",
    "beverage_features": """SELECT 'beverage_share' AS feature, branch, round(CAST(sum(CASE WHEN category LIKE 'coffee%' THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE) /
            CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE), 4) AS value FROM drinks WHERE NOT is_modifier GROUP BY branch
        UNION ALL SELECT 'opportunity ' || (category NOT LIKE 'coffee%'), branch, CAST(count(*) AS DOUBLE) FROM drinks WHERE NOT is_modifier GROUP BY ALL""",
    "pairs_output_order": """SELECT item_a, item_b, row_number() OVER (ORDER BY support0 DESC, count_ab DESC, item_a, item_b) - 1 AS position FROM pairs WHERE scope_type = 'overall'
        QUALIFY position < 20""",
    "reconcile_sources": """SELECT a.branch, a.source AS source_a, b.source AS source_b, 'total_revenue' AS metric, round(a.v, 2) AS value_a, round(b.v, 2) AS value_b,
        round(abs(a.v - b.v) / greatest(a.v, 1), 4) AS variance_pct, abs(a.v - b.v) / greatest(a.v, 1) <= 0.10 AS is_within_tolerance,
        CASE WHEN a.i = 1 AND b.i = 2 THEN 'monthly_sales is revenue truth; avg_sales is channel aggregate'
            WHEN a.i = 1 THEN 'items_by_group is mix truth, not revenue truth' ELSE 'cross-check channel aggregate vs product aggregate' END AS note
        FROM (SELECT 1 AS i, 'monthly_sales' AS source, branch, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS v FROM months GROUP BY branch
            UNION ALL SELECT 2, 'avg_sales_menu', branch, CAST(sum(CAST(sales AS DECIMAL(18,2))) AS DOUBLE) FROM menu GROUP BY branch) a
        JOIN (SELECT 2 AS i, 'avg_sales_menu' AS source, branch, CAST(sum(CAST(sales AS DECIMAL(18,2))) AS DOUBLE) AS v FROM menu GROUP BY branch
            UNION ALL SELECT 3, 'items_by_group', branch, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) FROM items WHERE NOT is_modifier GROUP BY branch) b
        ON a.branch = b.branch AND a.i < b.i""",
    "branch_month_features": """SELECT branch, monthname(date) AS month, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month_num, date, revenue,
        round(avg(revenue) OVER (PARTITION BY branch ORDER BY date ROWS 2 PRECEDING), 2) AS revenue_ma3, round(g, 4) AS mom_growth,
        round(stddev_samp(g) OVER (PARTITION BY branch ORDER BY date), 4) AS volatility, channel_delivery_share, CAST(NULL AS DOUBLE) AS beverage_share
        FROM (SELECT branch, date, y AS revenue, g FROM an0)
        LEFT JOIN (SELECT branch, round(max(CASE WHEN channel = 'DELIVERY' THEN sales END) / CAST(sum(CAST(sales AS DECIMAL(18,2))) AS DOUBLE), 4) AS channel_delivery_share FROM menu GROUP BY branch) USING (branch)""",
    "partial_history": """SELECT branch, monthname(date) AS month, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month_num, date, revenue,
        n < max(n) OVER () AS is_partial_history FROM (SELECT *, count(*) OVER (PARTITION BY branch) AS n FROM months)""",
    "item_features": """SELECT branch, item, division, "group", category, qty, amount,
        round(amount / CAST(sum(CAST(amount AS DECIMAL(18,2))) OVER (PARTITION BY branch) AS DOUBLE), 6) AS item_share,
        CAST(dense_rank() OVER (PARTITION BY branch ORDER BY amount DESC) AS INTEGER) AS item_rank,
        round(qty / CAST(sum(CAST(qty AS DECIMAL(18,2))) OVER (PARTITION BY branch) AS DOUBLE), 6) AS attach_tendency, true AS beverage_opportunity_flag
        FROM items WHERE NOT is_modifier""",
    "customer_rfm": """SELECT branch, customer, phone, first_order, last_order, total, num_orders, total = 0 AS is_zero_value_customer,
        CAST(date_diff('day', last_order, max(last_order) OVER ()) AS INTEGER) AS recency_days, CAST(date_diff('day', first_order, last_order) AS INTEGER) AS customer_lifespan_days,
        round(total / num_orders, 2) AS avg_order_value, num_orders > 1 AS is_repeat_customer FROM buyers""",
    "customer_segments": """SELECT branch, customer, phone, total, num_orders, CASE WHEN total = 0 OR total <= q33 THEN 'low' WHEN total > q66 THEN 'high' ELSE 'medium' END AS value_segment
        FROM buyers JOIN limits USING (branch)""",
    "segment_limits": "SELECT branch, round(q33, 4) AS q33, round(q66, 4) AS q66, round(median, 4) AS median FROM limits",
    "shift_flags": """SELECT emp_id, name, branch, date, punch_in, punch_out, duration_hours, shift_start_hour, shift_type, is_anomalous, is_valid_shift, day_of_week, weekend_flag FROM shifts""",
    "shift_features": """SELECT branch, round(median(duration_hours) FILTER (WHERE is_valid_shift), 2) AS median_hours,
        round(CAST(sum(CAST(duration_hours AS DECIMAL(18,4))) FILTER (WHERE is_valid_shift) AS DOUBLE) / count(*) FILTER (WHERE is_valid_shift), 2) AS mean_hours,
        count(*) FILTER (WHERE is_valid_shift) AS valid_shifts, count(DISTINCT CASE WHEN is_valid_shift THEN emp_id END) AS unique_employees,
        round(count(*) FILTER (WHERE is_valid_shift AND shift_type = 'morning')::DOUBLE / count(*) FILTER (WHERE is_valid_shift), 4) AS morning_pct,
        round(count(*) FILTER (WHERE is_valid_shift AND shift_type = 'afternoon')::DOUBLE / count(*) FILTER (WHERE is_valid_shift), 4) AS afternoon_pct,
        round(count(*) FILTER (WHERE is_valid_shift AND shift_type = 'evening')::DOUBLE / count(*) FILTER (WHERE is_valid_shift), 4) AS evening_pct,
        round(count(*) FILTER (WHERE is_valid_shift AND weekend_flag)::DOUBLE / count(*) FILTER (WHERE is_valid_shift), 4) AS weekend_shift_pct,
        count(*) AS total_shifts, round(count(*) FILTER (WHERE is_anomalous)::DOUBLE / count(*), 4) AS anomaly_rate FROM shifts GROUP BY branch""",
    "forward_fill": """SELECT conv_id, turn, role, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS UNBOUNDED PRECEDING)) AS last_user_md5 FROM conversations""",
    "supply_hourly": "SELECT * FROM hourly",
    "supply_profile": "SELECT * FROM profile",
    "demand_shape": """SELECT branch, day_of_week, hour, support_rows, slot_num_orders, branch_total_customer_rows_in_overlap, branch_total_num_orders_in_overlap,
        branch_staffed_slot_count, round(sh, 8) AS shape_weight_rows, round(st, 8) AS shape_support_strength,
        round(coalesce(CASE WHEN branch_total_num_orders_in_overlap > 0 THEN slot_num_orders / branch_total_num_orders_in_overlap END, 0), 8) AS shape_weight_num_orders FROM shape""",
    "demand_multipliers": "SELECT * FROM mult",
    "demand_total": "SELECT branch, day_of_week, hour, delivery_orders_est, total_orders_est_low, total_orders_est_base, total_orders_est_high FROM demand",
    "productivity_targets": "SELECT * FROM targ",
    "staffing_gap": """SELECT branch, day_of_week, hour, shift_bucket, avg_active_employees, target_orders_per_employee, required_employees_low, required_employees_base,
        required_employees_high, gap_low, gap_base, gap_high, status FROM gaps""",
    "staffing_findings": "SELECT * FROM found",
    "staffing_summary": """SELECT g.*, demand_confidence, understaffed_slots, balanced_slots, overstaffed_slots, worst_understaffed_slot, worst_overstaffed_slot, recommendation FROM (
        SELECT branch, count(*) AS staffed_slots, round(avg(avg_active_employees), 2) AS avg_active_employees, round(avg(required_employees_base), 2) AS avg_required_employees,
        round(avg(gap_base), 2) AS avg_gap, max(required_employees_base) AS peak_required_employees, round(max(gap_base), 2) AS peak_gap FROM gaps GROUP BY branch) g LEFT JOIN found USING (branch)""",
    "top_gap_slots": """SELECT branch, day_of_week, hour, avg_active_employees, required_employees_base, delivery_orders_est, total_orders_est_base, gap_base, status FROM (
        SELECT *, row_number() OVER (PARTITION BY branch ORDER BY abs(gap_base) DESC, dn, hour) AS rn FROM gaps) WHERE rn <= 10""",
    "attach_kpis": "SELECT * FROM kpi",
    "attach_revenue_share": "SELECT * FROM rev",
    "assoc_rules_pairs": """SELECT r.* FROM rules r JOIN rules0 p USING (branch, is_total, antecedents, consequents) WHERE ab >= 3""",
    "assoc_rules_top": "SELECT branch, is_total, antecedents, consequents, support, confidence, lift FROM top_rules",
    # At this support no set of three items is frequent on these tables, so all rules have one item on each side.
    "assoc_rules_fpgrowth": """SELECT branch, is_total, antecedents, consequents, round(ab::DOUBLE / nb, 6) AS support, round(ab::DOUBLE / na, 6) AS confidence,
        round((ab::DOUBLE / na) / (nc::DOUBLE / nb), 6) AS lift FROM rules1 WHERE ab::DOUBLE / nb >= 0.003 AND ab::DOUBLE / na >= 0.03""",
    "assoc_rules_sets": """SELECT branch, is_total, antecedents, consequents, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM wrules""",
    "assoc_rules_choice": """SELECT branch, is_total, antecedents, consequents, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM (
        SELECT *, row_number() OVER (PARTITION BY branch, is_total ORDER BY lift DESC, confidence DESC, antecedents, consequents) AS rn FROM (
            SELECT * FROM crules UNION ALL SELECT p.* FROM cpairs p WHERE NOT EXISTS (SELECT 1 FROM crules r WHERE r.branch = p.branch AND r.is_total = p.is_total))) WHERE rn <= 3""",
    "growth_potential": """SELECT branch, total_orders, beverage_orders, beverage_attachment_rate, best_branch_rate, beverage_gap_to_best, total_amount, bev_amount, bev_revenue_share,
        round(s1, 6) AS low_attachment_score, round(s2, 6) AS order_volume_score, round(avg_lift0, 6) AS avg_lift, round(s3, 6) AS assoc_lift_score, potential_score,
        CAST(rank() OVER (ORDER BY potential_score DESC) AS INTEGER) AS potential_rank, top_bundle_rule FROM pot""",
    "growth_actions": """SELECT branch, potential_score, beverage_attachment_rate AS current_attachment_rate, beverage_gap_to_best, top_bundle_rule AS recommended_bundle,
        CASE WHEN potential_score >= 0.5 THEN 'Priority cross-sell: promote beverage bundles at checkout' ELSE 'Maintain existing bundle promotions and monitor' END AS action FROM pot""",
    "item_classes": """SELECT p_name AS item, CASE WHEN regexp_matches(p_name, '\\banvil\\b') THEN NULL WHEN regexp_matches(' ' || p_name || ' ', '(^|[\\s\\-])hot([\\s\\-]|$)') THEN 'coffee'
        WHEN regexp_matches(' ' || p_name || ' ', '(^|[\\s\\-])cold([\\s\\-]|$)') THEN 'milkshake' END AS class, count(*) AS n FROM part GROUP BY ALL""",
    "revenue_kpis": """SELECT branch, round(avg_monthly_revenue, 6) AS avg_monthly_revenue, round(recent_growth_rate, 6) AS recent_growth_rate,
        round(revenue_volatility, 6) AS revenue_volatility, round(pct_change_first_last, 6) AS pct_change_first_last, n_months, is_partial_history FROM rk""",
    "order_kpis": "SELECT branch, CAST(orders_count AS BIGINT) AS orders_count, total_customer_revenue, round(total_customer_revenue / orders_count, 4) AS avg_order_value FROM ok",
    "branch_kpis": """SELECT branch, n_months, is_partial_history, CAST(orders_count AS BIGINT) AS orders_count, total_customer_revenue, delivery_revenue, delivery_order_count, """ + ", ".join(
        f"round({c}, 6) AS {c}" for c in ("avg_monthly_revenue", "recent_growth_rate", "revenue_volatility", "pct_change_first_last", "avg_order_value",
                                          "delivery_share", "revenue_per_hour", "tax_burden")) + " FROM bk",
    "feasibility_scores": "SELECT branch, feasibility_score, score_tier, top_drivers, " + ", ".join(
        f"round({c}, 6) AS {c}" for c in ("avg_monthly_revenue", "recent_growth_rate", "revenue_volatility", "avg_order_value", "delivery_share", "revenue_per_hour",
                                          "norm_growth", "norm_revenue", "norm_volatility", "norm_avg_order", "norm_delivery", "norm_ops_eff", "stability")) + " FROM fs",
    "region_scores": "SELECT * FROM rs",
    "region_decision": """SELECT CASE k WHEN 1 THEN 'North' WHEN 2 THEN 'South' ELSE 'East' END AS recommended_region, best_branch_to_replicate, feasibility_tier, overall_feasibility,
        strongest_growth_branch, CASE k WHEN 1 THEN 'Harbour, Old Town' WHEN 2 THEN 'Market, Station' ELSE 'Hill, River' END AS candidate_locations,
        CASE WHEN k = 3 THEN 'existing branches are close to each other' END AS warning FROM (
        SELECT *, CASE WHEN area = 'north' OR strongest_growth_branch = 'EUROPE' THEN 1 WHEN area = 'south' OR strongest_growth_branch = 'AFRICA' THEN 2 ELSE 3 END AS k,
        (SELECT branch FROM fs WHERE region = area ORDER BY feasibility_score DESC, branch LIMIT 1) AS best_branch_to_replicate FROM (
            SELECT (SELECT region FROM rs ORDER BY region_score DESC, region LIMIT 1) AS area, (SELECT branch FROM rk ORDER BY round(recent_growth_rate, 6) DESC, branch LIMIT 1) AS strongest_growth_branch,
            (SELECT score_tier FROM fs ORDER BY feasibility_score DESC, branch LIMIT 1) AS feasibility_tier, (SELECT max(feasibility_score) FROM fs) AS overall_feasibility))""",
    "branch_ranking": "SELECT CAST(row_number() OVER (ORDER BY feasibility_score DESC, branch) AS INTEGER) AS rank, branch, region, feasibility_score, score_tier, top_drivers FROM fs",
    "growth_summary": """SELECT rk.branch, region, round(rk.recent_growth_rate, 6) AS growth_rate, round(pct_change_first_last, 4) AS pct_change, rk.recent_growth_rate > 0 AS is_growing
        FROM rk JOIN fs ON rk.branch = fs.branch""",
    "risk_summary": """SELECT branch, region, round(revenue_volatility, 4) AS revenue_volatility, round(norm_volatility, 4) AS norm_volatility,
        CASE WHEN norm_volatility >= 0.65 THEN 'High' WHEN norm_volatility >= 0.35 THEN 'Medium' ELSE 'Low' END AS risk_tier, round(1 - norm_volatility, 4) AS stability_score FROM fs""",
    "forecast_anomalies": "SELECT branch, date, CAST(t AS INTEGER) AS t, y, round(g, 6) AS growth, anomaly, weight FROM an",
    "forecast_scenarios": "SELECT branch, scenario, date, y, w FROM sc",
    "forecast_estimators": """SELECT branch, scenario, n, round(naive, 4) AS naive, round(wma3, 4) AS wma3, round(slope, 4) AS slope, round(vs, 4) AS volatility FROM es""",
    "forecast_ensemble": """SELECT branch, scenario, p AS forecast_period, p = 1 AS is_primary,
        strftime(make_date(CAST((lt + p) // 12 AS INTEGER), CAST((lt + p) % 12 + 1 AS INTEGER), 1), '%B %Y') AS forecast_month, round(val, 2) AS demand_index_forecast,
        round(CASE WHEN cy > 0 THEN (val - cy) / cy ELSE 0 END, 4) AS expected_change_vs_last_clean_month, round(lo, 2) AS relative_band_low, round(hi, 2) AS relative_band_high,
        round(CASE WHEN val > 0 THEN (hi - lo) / val ELSE 0 END, 4) AS band_width_pct, round(naive, 2) AS naive_estimate, round(wma3, 2) AS wma3_estimate,
        round(linear, 2) AS linear_estimate, CAST(NULL AS DOUBLE) AS similarity_estimate, 'ensemble_median' AS method,
        CASE WHEN n >= 5 AND vol < 0.5 THEN 'medium' WHEN n >= 4 AND vol < 1.0 THEN 'low-medium' ELSE 'low' END AS confidence_level,
        least(100, sq + sv + sa + sn) AS forecast_stability_score, CASE WHEN sq + sv + sa + sn >= 60 THEN 'stable' WHEN sq + sv + sa + sn >= 30 THEN 'cautious' ELSE 'unstable' END AS forecast_stability_label,
        sq AS stability_data_qty, sv AS stability_volatility, sa AS stability_agreement, sn AS stability_anomaly, n AS n_months_used,
        monthname(make_date(CAST(ct // 12 AS INTEGER), CAST(ct % 12 + 1 AS INTEGER), 1)) AS last_clean_month, dec AS december_anomaly_flag FROM en3""",
    "forecast_short_series": """SELECT k AS branch, scenario, p AS forecast_period, round(val, 2) AS demand_index_forecast, round(sim, 2) AS similarity_estimate,
        round(greatest(0.0::DOUBLE, lo * (1 - cap)), 2) AS relative_band_low, round(hi * (1 + cap), 2) AS relative_band_high, n AS n_months_used FROM (
        SELECT *, CASE WHEN sim IS NULL THEN s[1] + 0.5::DOUBLE * (s[2] - s[1]) ELSE s[1] + 0.75::DOUBLE * (s[2] - s[1]) END AS lo,
        CASE WHEN sim IS NULL THEN s[2] + 0.5::DOUBLE * (s[3] - s[2]) ELSE s[3] + 0.25::DOUBLE * (s[4] - s[3]) END AS hi,
        (SELECT v FROM (SELECT v, sum(w) OVER (ORDER BY v, w ROWS UNBOUNDED PRECEDING) AS c FROM (
            SELECT naive AS v, 1.0::DOUBLE AS w UNION ALL SELECT wma3, 1.0 UNION ALL SELECT linear, 1.0 UNION ALL SELECT sim, 0.5 WHERE sim IS NOT NULL))
            WHERE c >= (CASE WHEN sim IS NULL THEN 1.5 ELSE 1.75 END) ORDER BY c LIMIT 1) AS val FROM (
        SELECT *, list_sort(CASE WHEN sim IS NULL THEN [naive, wma3, linear] ELSE [naive, wma3, linear, sim] END) AS s, least(vol, 0.75::DOUBLE) AS cap FROM (
        SELECT qs.k, scenario, p, qs.n, qs.naive, qs.wma3, CASE WHEN qs.slope IS NULL THEN qs.naive ELSE greatest(0.0::DOUBLE, qs.slope * (qs.st + p) + (qs.my - qs.slope * (qs.mx + qs.t0))) END AS linear,
            CASE WHEN qs.b = 'EUROPE' AND r.k IS NOT NULL THEN qs.naive * CASE WHEN r.y2 IS NULL THEN 1 ELSE pow(1 + greatest((r.y1 - r.y2) / r.y2, -1.0::DOUBLE), p) END END AS sim,
            CASE WHEN scenario = 'base' OR coalesce(round(qs.vs, 4), 0) = 0 THEN qs.vs ELSE round(qs.vs, 4) END AS vol
        FROM qs LEFT JOIN qs r ON r.b = 'ASIA' AND r.q = qs.q, (VALUES ('base'), ('surge_sensitive')) AS c(scenario), (VALUES (1), (2), (3)) AS h(p))))""",
    "forecast_backtest": """SELECT branch, count(*) AS n_holdout, round(avg(abs(round(val, 2) - y) / y), 6) AS mape_ensemble, round(avg(abs(round(naive, 2) - y) / y), 6) AS mape_naive,
        round(avg(abs(round(wma3, 2) - y) / y), 6) AS mape_wma3, round(avg(abs(round(linear, 2) - y) / y), 6) AS mape_linear,
        round(avg(CASE WHEN y BETWEEN round(lo, 2) AND round(hi, 2) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS band_coverage FROM bt WHERE o = 3 GROUP BY branch""",
    "forecast_rolling_backtest": """SELECT branch, p AS forecast_period, count(*) AS n_origins, round(avg(abs(round(val, 2) - y) / y), 6) AS mape_ensemble,
        round(avg(abs(round(naive, 2) - y) / y), 6) AS mape_naive, round(avg(abs(round(wma3, 2) - y) / y), 6) AS mape_wma3, round(avg(abs(round(linear, 2) - y) / y), 6) AS mape_linear,
        round(avg(CASE WHEN y BETWEEN round(lo, 2) AND round(hi, 2) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS band_coverage FROM bt GROUP BY branch, p""",
    "forecast_metadata": """SELECT CAST(2 * 3 * n AS BIGINT) AS total_rows, branches, 'base|surge_sensitive' AS scenarios, 3 AS periods_per_scenario, parameter, value FROM
        (SELECT count(DISTINCT branch) AS n, string_agg(DISTINCT branch, '|' ORDER BY branch) AS branches FROM months),
        (VALUES ('WMA_WEIGHTS', '[0.5, 0.3, 0.2]'), ('VOLATILITY_CAP', '0.75'), ('SIMILARITY_BELOW', '4'), ('SIMILARITY_WEIGHT', '0.5')) AS v(parameter, value)""",
    "pair_metadata": """SELECT count(*) AS total_pairs, string_agg(DISTINCT scope_type, '|' ORDER BY scope_type) AS scope_types, string_agg(DISTINCT branch, '|' ORDER BY branch) AS branches,
        0.001::DOUBLE AS min_support, 10 AS min_count_ab FROM pairs""",
    "item_lists": """SELECT order_id, CASE WHEN CAST(order_id AS BIGINT) % 5 < 3 THEN array_to_string(items, '|') ELSE '' END AS items FROM bask""",
    "report_roundtrip": """SELECT branch, monthname(date) AS month, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month_num, revenue, date FROM months""",
    "report_order_detail": """SELECT branch, is_void, is_modifier, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_baskets, CAST(sum(price) AS DOUBLE) AS price, CAST(sum(qty) AS DOUBLE) AS qty FROM (
        SELECT *, qty < 0 AS is_void, price = 0 AND NOT qty < 0 AS is_modifier FROM (
        SELECT branch, l_orderkey, CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS price,
        CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS DECIMAL(18,2)) AS qty FROM lineitem JOIN ord ON l_orderkey = o_orderkey)) GROUP BY ALL""",
    "report_basket_core": """SELECT branch, 'Person_' || l_orderkey AS customer, string_agg(p_name, '|' ORDER BY p_name) AS items, count(DISTINCT p_name) AS unique_items,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS net_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS net_total
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN ord ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' AND l_linenumber <> 7
        GROUP BY branch, l_orderkey HAVING sum(l_quantity) > 0""",
    "report_items": 'SELECT branch, division, "group", item, qty, amount FROM item0',
    "report_attendance": """SELECT emp_id, branch, date, count(*) AS n, round(CAST(sum(CAST(floor(h) + floor(h * 60 % 60) / 60.0::DOUBLE + floor(h * 3600 % 60) / 3600.0::DOUBLE AS DECIMAL(18,6))) AS DOUBLE), 3) AS hours
        FROM shift0 GROUP BY ALL""",
    "line_explode": "SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, CAST(max(line_no) AS INTEGER) AS last_line FROM doc_lines GROUP BY doc_id",
    "line_classes": """SELECT doc_id, count(*) FILTER (WHERE p) AS is_page_break, count(*) FILTER (WHERE f) AS is_footer, count(*) FILTER (WHERE b) AS is_blank,
        count(*) FILTER (WHERE p OR f OR b) AS is_noise, count(*) FILTER (WHERE regexp_matches(line, '^\\d{2}-\\w{3}-\\d{2}')) AS is_date_line,
        count(*) FILTER (WHERE regexp_matches(line, '^\\s*,?\\s*Total', 'i')) AS is_total FROM (
        SELECT *, regexp_matches(line, 'Page\\s+\\d+\\s+of', 'i') AS p, regexp_matches(line, 'Copyright|All Rights Reserved|^REP_S_\\d+,', 'i') AS f,
        regexp_replace(replace(line, ',', ''), '^\\s+|\\s+$', '', 'g') = '' AS b FROM doc_lines) GROUP BY doc_id""",
    "number_parse": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS parsed FROM orders""",
}

SQL: dict[str, str] = {name: half_even(with_parts(body)) for name, body in BODIES.items()}
