"""The queries on training data by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

EFFECTIVE = """e as (select pair_id, lower(trim(split)) as split from (select *, row_number() over (partition by pair_id order by pair_version desc, created_at desc, loaded_at desc, id desc) as n
    from pair_adjudications where pair_id is not null and pair_version is not null) where n = 1 and lower(trim(decision)) = 'approve' and trim(split) <> '')"""
#: The groups of related pairs by repeated joins; the other problems are held against brute force in the tests.
P4_FOUND = f"""with recursive {EFFECTIVE},
 r as (select distinct p.id, e.split, p.owner_id, p.request_id, trim(lower(regexp_replace(split_part(p.source_provenance, ';', 1), '\\s+', ' ', 'g'))) as source from parallel_pairs p join e on e.pair_id = p.id),
 k as (select id, 'o' || owner_id as key from r where trim(owner_id) <> '' union select id, 'r' || request_id from r where trim(request_id) <> ''
   union select id, 's' || source from r where regexp_matches(source, '[\\p{{L}}\\p{{N}}]') and source not in ('n/a', 'unknown', 'б/и', 'неизвестно')),
 c(id, low) as (select id, id from r union select k2.id, c.low from c join k k1 on k1.id = c.id join k k2 on k2.key = k1.key where c.low < k2.id),
 g as (select id, min(low) as group_id from c group by 1),
 t as (select group_id from g join r using (id) group by 1 having count(distinct split) > 1)
 select id as pair_id, group_id from g join t using (group_id)"""
ORACLE: dict[str, str] = {"p4_found": P4_FOUND}


def _lazy(module: str, name: str):
    def run(spark, sf_dir):
        from corvane.session import ship

        ship(spark)
        return getattr(importlib.import_module(f"corvane.llm.{module}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


MODULES = {
    "garble": ("p9_found", "p9_restored"),
    "language": ("p6_found", "p6_parts"),
    "mixing": ("p8_mix", "p8_shares"),
    "tokens": ("p7_ids",),
    "minhash": ("p1_found", "p1_groups"),
    "overlap": ("p2_found", "p2_counterparts", "p2_counts"),
    "plain": ("p5_found", "p5_plain", "p5_steps"),
    "votes": ("p3_found", "p3_consensus", "p3_reliability"),
    "splits": ("p4_found", "p4_assignment", "p4_shares"),
}
QUERIES = {name: _lazy(module, name) for module, names in MODULES.items() for name in names}
