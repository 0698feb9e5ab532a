import datetime as dt
import random
from collections import Counter

import pytest

from newsloom.functions import rules
from newsloom.operators import sections

SECTIONS = ("top_news", "insight", "deep_asset", "watchlist")
SCHEMA = "report_date date, event_id string, normalized_event_type string, main_entity string, main_platform string, place int, final_score double, importance_score double, source_score double, is_paper boolean, is_trending boolean, is_reusable boolean, " + ", ".join(f"scores_{s} double, may_{s} boolean" for s in SECTIONS)


def model(rows):
    """The sections of one day, chosen in turn from all its rows."""
    taken, out = set(), {}
    for s in SECTIONS:
        size = rules.SECTION_SIZES[s]
        key = lambda r: (-r[f"scores_{s}"], -r["final_score"], -r["importance_score"], -r["source_score"], r["place"])  # noqa: E731, B023
        able = sorted((r for r in rows if r[f"may_{s}"] and r["event_id"] not in taken), key=key)
        held, kinds, entities, platforms = [], Counter(), Counter(), Counter()
        for r in able:
            k, e, p = r["normalized_event_type"], r["main_entity"], r["main_platform"]
            blocked = kinds[k] >= sections.type_limit(k) or (e and entities[e] >= rules.ENTITY_LIMIT) or (p and platforms[p] >= rules.PLATFORM_LIMIT) if s == "top_news" else e and entities[e]
            if blocked or len(held) == size:
                continue
            held.append(r)
            kinds[k], entities[e], platforms[p] = kinds[k] + 1, entities[e] + 1, platforms[p] + 1
        if s in ("insight", "deep_asset"):
            good = [r for r in able if r[f"scores_{s}"] >= 58 and (s == "insight" or (r["is_paper"] and r["is_reusable"]))]
            for kind in ("is_paper", "is_trending"):
                extra = next((r for r in good if r[kind]), None)
                if extra is None or any(r[kind] or r["event_id"] == extra["event_id"] for r in held):
                    continue
                if len(held) < size:
                    held = [*held, extra]
                    continue
                others = [i for i, r in enumerate(held) if not r["is_paper"]] or list(range(len(held)))
                held[min(others, key=lambda i: held[i][f"scores_{s}"])] = extra  # noqa: B023
            held = sorted(held, key=lambda r: key(r)[:4])[:size]
        taken |= {r["event_id"] for r in held}
        out |= {r["event_id"]: (s, n + 1) for n, r in enumerate(held)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_choices_equal_unpruned_model(spark, seed):
    r = random.Random(seed)
    rows = []
    for day in range(25):
        crowd = r.choice([8, 60, 200])
        few = r.random() < 0.5
        for i in range(crowd):
            row = {"report_date": dt.date(2026, 1, 1 + day), "event_id": f"e{i}", "normalized_event_type": r.choice(["model_release", "research", "x"]), "main_entity": r.choice(["", "a", "b"] if few else ["", *(f"n{j}" for j in range(40))]), "main_platform": r.choice(["", "p", "q", "r"]), "place": i}
            row |= {c: float(r.randint(40, 60) if few else r.randint(20, 90)) for c in ("final_score", "importance_score", "source_score")} | {f"scores_{s}": float(r.randint(50, 62) if few else r.randint(30, 95)) for s in SECTIONS}
            row |= {f"may_{s}": r.random() < 0.7 for s in SECTIONS} | {"is_paper": r.random() < 0.1, "is_trending": r.random() < 0.05, "is_reusable": r.random() < 0.5}
            rows.append(row)
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    got = {}
    for x in sections.choices(spark.createDataFrame([tuple(x[c] for c in columns) for x in rows], SCHEMA)).collect():
        got.setdefault(x.report_date, {})[x.event_id] = (x.report_section, x.position)
    for day in {x["report_date"] for x in rows}:
        assert got.get(day, {}) == model([x for x in rows if x["report_date"] == day]), day
