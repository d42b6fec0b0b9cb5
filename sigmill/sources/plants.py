"""Plants as JSON: own form to write, own and the common fixture form to read."""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import Any

from ..plans import models as M
from ..plans.plant import Plant


def _model(m: M.Model) -> dict[str, Any]:
    out = {"kind": m.kind, "name": m.name, "inputs": m.inputs, "additive": m.additive, "output": m.output}
    if isinstance(m, M.GainSchedModel):
        out["params"] = asdict(m.g)
    elif isinstance(m, (M.UnitModel, M.PidModel)):
        out["params"] = asdict(m.p)
    elif isinstance(m, M.SelectModel):
        out["params"] = {"which": m.which}
    else:
        out["params"] = {k: getattr(m, k) for k in ("factor", "y_min", "y_max", "bad")}
    return out


def plant_to_json(plant: Plant) -> str:
    return json.dumps({"plant": plant.name, "description": plant.description, "models": [_model(m) for m in plant.models.values()], "edges": plant.edges})


def _own(x: dict[str, Any]) -> M.Model:
    p, wires = x["params"], (x["inputs"], x["output"])
    match x["kind"]:
        case "unit":
            return M.UnitModel(x["name"], M.UnitParameters(**p), *wires, x["additive"])
        case "gain_sched":
            return M.GainSchedModel(x["name"], M.GainSchedParameters(**p), *wires, x["additive"])
        case "pid":
            p = p | {"y_range": tuple(p["y_range"]), "u_range": tuple(p["u_range"])}
            return M.PidModel(x["name"], M.PidParameters(**p), *wires)
        case "select":
            return M.SelectModel(x["name"], p["which"], *wires)
        case "divide":
            return M.DivideModel(x["name"], *wires, **p)
    raise ValueError(f"unknown kind of model: {x['kind']}")


def _number(v: Any) -> float | None:
    """Numbers may be strings; NaN means no value."""
    if v is None or v == "NaN":
        return None
    return float(v)


def _numbers(v: Any) -> list[float] | None:
    return None if v is None else [float(x) for x in v]


def _foreign(name: str, x: dict[str, Any]) -> M.Model:
    kind = x.get("$type", "").split(",")[0].rpartition(".")[2]
    inputs, output, additive = x["ModelInputIDs"], x["outputID"], x.get("additiveInputIDs")
    if kind == "PidModel":
        p = x["pidParameters"]
        s = p.get("Scaling") or {}
        f = p.get("Filtering") or {}
        if (p.get("GainScheduling") or {}).get("GSActive_b"):
            raise ValueError(f"{name}: scheduled controllers aren't supported")
        return M.PidModel(name, M.PidParameters(
            _number(p["Kp"]), _number(p.get("Ti_s")) or 0.0, _number(p.get("Td_s")) or 0.0, _number(p.get("u0", 50)),
            (s.get("y_min", 0.0), s.get("y_max", 100.0)), (s.get("u_min", 0.0), s.get("u_max", 100.0)), bool(s.get("doesSasPidScaleKp")),
            _number(f.get("TimeConstant_s")) or 0.0, int(f.get("FilterOrder") or 0), bool(p.get("DelayOutputOneSample")),
        ), inputs, output)
    if kind == "UnitModel":
        p = x["modelParameters"]
        return M.UnitModel(name, M.UnitParameters(
            _numbers(p["LinearGains"]), _number(p.get("Bias")) or 0.0, _number(p.get("TimeConstant_s")) or 0.0, _number(p.get("TimeDelay_s")) or 0.0,
            _number(p.get("DampingRatio")) or 0.0, _numbers(p.get("Curvatures")), _numbers(p.get("U0")), _numbers(p.get("UNorm")), _number(p.get("Y_min")), _number(p.get("Y_max")),
        ), inputs, output, additive)
    if kind == "GainSchedModel":
        p = x["modelParameters"]
        return M.GainSchedModel(name, M.GainSchedParameters(
            [_numbers(g) for g in p["LinearGains"]], _numbers(p.get("LinearGainThresholds")) or [], _numbers(p.get("TimeConstant_s")) or [0.0],
            _numbers(p.get("TimeConstantThresholds")) or [], _number(p.get("TimeDelay_s")) or 0.0, _number(p.get("OperatingPoint_U")) or 0.0, _number(p.get("OperatingPoint_Y")) or 0.0,
        ), inputs, output, additive)
    if kind == "Select":
        return M.SelectModel(name, "MAX" if "MAX" in str(x.get("type", "")).upper() or x.get("type") == 1 else "MIN", inputs, output)
    if kind == "Divide":
        return M.DivideModel(name, inputs, output)
    raise ValueError(f"unknown type of model: {kind}")


def plant_from_json(text: str) -> Plant:
    x = json.loads(text)
    if "modelDict" in x:
        return Plant([_foreign(k, m) for k, m in x["modelDict"].items()], x.get("plantName") or "plant", x.get("plantDescription") or "")
    return Plant([_own(m) for m in x["models"]], x["plant"], x.get("description", ""))
