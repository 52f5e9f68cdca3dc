"""A logged statement that several test files read."""

# The workload's statement for one knob setting (fact_event_l, two
# joins, group by, order by, window, limit 100, literal 450), as a user of the
# account-usage log would find it.
SPEC_TEXT = """with
    filtered as (
        select
            dim_customer_wl.customer_segment,
            dim_product_wl.product_category,
            fact_event.customer_id,
            fact_event.product_id,
            fact_event.amount
        from fact_event_l as fact_event
        inner join dim_customer_wl on fact_event.customer_id = dim_customer_wl.customer_id
        inner join dim_product_wl on fact_event.product_id = dim_product_wl.product_id
        where cast(substr(fact_event.event_code, 3, 3) as integer)
            < {literal}
    ),

    ranked as (
        select
            filtered.*,
            row_number() over (
                partition by filtered.customer_id
                order by filtered.amount desc
            ) as amount_rank
        from filtered
    )

    select
        customer_segment,
        product_category,
        customer_id,
        count(*) as query_rows,
        sum(amount) as amount_total,
        count(distinct product_id) as products,
        max(amount_rank) as deepest_rank
    from ranked
    group by customer_segment, product_category, customer_id
    order by amount_total desc
    limit 100"""
