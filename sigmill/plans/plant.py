"""Plants: models wired by signal names, their order, their steady state and their simulation.

Planning happens once on the driver, where graphs are small.  Simulation
is sequential in time and parallel over plants and scenarios, each a group
of rows (see ``simulate``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.recursive import missing
from .models import Model, PidModel, SelectModel

#: Bad data for longer than this share of the largest time constant restarts the models.
RESTART = 0.2


class Plant:
    def __init__(self, models: Iterable[Model], name: str = "plant", description: str = "") -> None:
        self.name, self.description = name, description
        self.models = {m.name: m for m in models}
        self.external: list[str] = []
        self._plan()

    def _plan(self) -> None:
        self.producer = {m.output: m.name for m in self.models.values()}
        self.edges = [(self.producer[s], m.name) for m in self.models.values() for s in m.all_inputs if s in self.producer]
        self.external = sorted({s for m in self.models.values() for s in m.all_inputs if s not in self.producer})
        #: PID-controlled signals, and the model each comes from.
        self.controlled = {m.inputs[0]: self.producer[m.inputs[0]] for m in self.models.values() if isinstance(m, PidModel) and m.inputs[0] in self.producer}
        self.order, self.loops = self._order()

    # Wiring
    def connect(self, upstream: str, downstream: str, index: int | None = None, additive: bool = False) -> str:
        """Feed a model's output to another's input; returns the signal."""
        signal = self.models[upstream].output
        self.connect_signal(signal, downstream, index, additive)
        return signal

    def connect_signal(self, signal: str, downstream: str, index: int | None = None, additive: bool = False) -> None:
        m = self.models[downstream]
        if additive:
            m.additive.append(signal)
        elif index is None:
            m.inputs.append(signal)
        else:
            m.inputs[index] = signal
        self._plan()

    # Graph
    def downstream(self, name: str) -> list[str]:
        return sorted({b for a, b in self.edges if a == name})

    def upstream(self, name: str) -> list[str]:
        return sorted({a for a, b in self.edges if b == name})

    def all_downstream(self, name: str) -> list[str]:
        return self._closure(name, self.downstream)

    def all_upstream(self, name: str) -> list[str]:
        return self._closure(name, self.upstream)

    @staticmethod
    def _closure(name, step) -> list[str]:
        seen, todo = [], [name]
        while todo:
            for n in step(todo.pop(0)):
                if n not in seen:
                    seen.append(n)
                    todo.append(n)
        return seen

    def upstream_pids(self, name: str) -> list[str]:
        return [n for n in self.upstream(name) if isinstance(self.models[n], PidModel)]

    def controlled_by(self, pid: str) -> str | None:
        """The model whose output a PID measures."""
        return self.producer.get(self.models[pid].inputs[0])

    def free_inputs(self, name: str) -> list[int]:
        return [i for i, s in enumerate(self.models[name].inputs) if s in self.producer]

    def _order(self) -> tuple[list[str], list[list[str]]]:
        """Calculation order; a PID sees its measurement one sample late, so that edge doesn't count."""
        need = {n: set() for n in self.models}
        for m in self.models.values():
            for i, s in enumerate(m.all_inputs):
                if s in self.producer and not (isinstance(m, PidModel) and i == 0):
                    need[m.name].add(self.producer[s])
        order: list[str] = []
        while len(order) < len(need):
            ready = sorted(n for n in need if n not in order and need[n] <= set(order))
            if ready:
                order += sorted(ready, key=lambda n: (not isinstance(self.models[n], PidModel), n))
                continue
            # A computational loop: go on with the first PID in it, or else the first model by name.
            left = sorted((n for n in need if n not in order), key=lambda n: (not isinstance(self.models[n], PidModel), n))
            order.append(left[0])
        loops = sorted({tuple(sorted({n, *(m for m in self.all_downstream(n) if n in self.all_downstream(m))})) for n in self.models if n in self.all_downstream(n)})
        return order, [list(x) for x in loops]

    def minimal_signals(self) -> list[str]:
        return self.external

    # Steady state
    def steady_state(self, known: dict[str, float]) -> dict[str, float] | None:
        """All signals at rest, given the external ones; None if they can't be found."""
        values = {k: v for k, v in known.items() if not missing(v)}
        for m in self.models.values():
            if isinstance(m, PidModel) and len(m.inputs) > 2:
                for s in m.inputs[2:]:
                    values.setdefault(s, math.nan) if s not in self.producer else None
        pids = [m for m in self.models.values() if isinstance(m, PidModel)]
        selected = {s: m for m in self.models.values() if isinstance(m, SelectModel) for s in m.inputs}
        free = [p for p in pids if p.output not in selected]
        self._spread(values, free)
        # One of the PIDs before a select block is active; the others follow it.
        for block in {id(m): m for m in selected.values()}.values():
            rivals = [p for p in pids if p.output in block.inputs]
            tried = []
            for p in rivals:
                trial = dict(values)
                self._spread(trial, [*free, p])
                if all(m.output in trial for m in self.models.values()):
                    e = [(q.p.kp * (trial[q.inputs[1]] - trial[q.inputs[0]])) for q in rivals if q.inputs[0] in trial and q is not p]
                    tried.append((all(x >= -1e-9 if block.which == "MIN" else x <= 1e-9 for x in e), trial))
            if tried:
                values = next((t for ok, t in tried if ok), tried[0][1])
        if not all(m.output in values for m in self.models.values()):
            self._loops(values)
        return values if all(m.output in values for m in self.models.values()) else None

    def _spread(self, values: dict[str, float], pids: list[PidModel]) -> None:
        """Fill in signals forwards and backwards until nothing changes."""
        moved = True
        while moved:
            before = len(values)
            for n in self.order:
                m = self.models[n]
                if isinstance(m, PidModel):
                    y, yset = m.inputs[:2]
                    if m in pids and yset in values:
                        values.setdefault(y, values[yset])
                    elif m in pids and y in values:
                        values[yset] = values[y]
                    continue
                known = [s in values for s in m.all_inputs]
                if all(known) and m.output not in values:
                    values[m.output] = m.steady_output([values[s] for s in m.all_inputs])
                elif isinstance(m, SelectModel) and m.output in values:
                    for s in m.inputs:
                        values.setdefault(s, values[m.output])
                elif m.output in values and known.count(False) == 1 and not known[: len(m.inputs)].count(False) == 0:
                    i = known.index(False)
                    u = m.steady_input(values[m.output], i, [values.get(s, math.nan) for s in m.all_inputs])
                    if u is not None:
                        values[m.all_inputs[i]] = u
            moved = len(values) > before

    def _loops(self, values: dict[str, float], rounds: int = 50) -> None:
        """Loops without a PID: repeated substitution from zero."""
        names = [n for n in self.order if self.models[n].output not in values and not isinstance(self.models[n], PidModel)]
        trial = dict(values) | {self.models[n].output: 0.0 for n in names}
        for _ in range(rounds):
            for n in names:
                m = self.models[n]
                if any(s not in trial for s in m.all_inputs):
                    return
                trial[m.output] = m.steady_output([trial[s] for s in m.all_inputs])
        if all(math.isfinite(trial[self.models[n].output]) for n in names):
            values.update(trial)

    # Simulation
    def run(self, data: dict[str, np.ndarray], dt: float, ignore: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], int]:
        """All simulated signals over the external ones, and the number of restarts.

        A PID's measurement is the process's output one sample before plus
        this sample's additive inputs; ``<model>`` holds that process
        output.  Ignored samples repeat the last good inputs.
        """
        for m in self.models.values():
            if why := m.simulatable():
                raise ValueError(f"{m.name}: {why}")
        n = len(next(iter(data.values())))
        ignore = np.zeros(n, bool) if ignore is None else ignore
        good = int(np.argmin(ignore)) if n and not ignore.all() else 0
        start = self.steady_state({s: float(data[s][good]) for s in self.external if s in data})
        if start is None:
            raise ValueError(f"{self.name}: no steady state found")
        signals = {s: data[s].astype(float) for s in self.external if s in data}
        sim = {m.output: np.full(n, start[m.output]) for m in self.models.values()}
        for m in self.models.values():
            if m.additive or m.output in self.controlled:
                sim[m.name] = np.full(n, start[m.output] - sum(start.get(s, 0.0) for s in m.additive))
        for s, v in start.items():
            if s not in signals and s not in sim:
                signals[s] = np.full(n, v)
        read = signals | sim
        # The longest run of bad samples that needs no restart.
        slowest = max((m.largest_time_constant() for m in self.models.values()), default=0.0)
        patience = math.ceil(RESTART * slowest / dt) if dt else 0
        at, before, bad, restarts = good, good, 0, -1
        plan = [(m, [read[s] for s in m.all_inputs]) for m in map(self.models.get, self.order)]
        for k in range(n):
            fresh = k == 0
            if not ignore[k]:
                fresh |= slowest > 0 and bad > patience
                before, at, bad = at, k, 0
            else:
                bad += 1
            if fresh:
                restarts += 1
                for m, inputs in plan:
                    m.warm_start([x[k] for x in inputs], read[m.output][k])
            for m, inputs in plan:
                if isinstance(m, PidModel) and k > 0 and m.inputs[0] in self.controlled:
                    process = self.models[self.controlled[m.inputs[0]]]
                    sim[process.output][k] = sim[process.name][before] + sum(read[s][at] for s in process.additive)
                    y = [inputs[0][k], *(x[at] for x in inputs[1:])]
                else:
                    y = [x[at] for x in inputs]
                out, inner = m.step(y, dt)
                if m.name in sim:
                    sim[m.name][k] = inner
                if m.output not in self.controlled:
                    sim[m.output][k] = out
        return sim, restarts


def simulate(inputs: DataFrame, plants: dict[str, str], dt: float, detect_bad: bool = True) -> DataFrame:
    """(plant_id, scenario_id, k, signals...) -> plant_id, scenario_id, k, signal, value.

    `plants` maps plant_id to its JSON; each (plant, scenario) is simulated
    in one task.  Samples with a missing input are ignored.
    """
    shared = inputs.sparkSession.sparkContext.broadcast(plants)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from ..sources.plants import plant_from_json

        plant = plant_from_json(shared.value[key[0]])
        pdf = pdf.sort_values("k")
        data = {s: pdf[s].to_numpy(float, na_value=np.nan) for s in plant.external if s in pdf}
        bad = np.any([np.isnan(v) for v in data.values()], axis=0) if detect_bad and data else None
        sim, _ = plant.run(data, dt, bad)
        k = pdf["k"].to_numpy()
        parts = [pd.DataFrame({"plant_id": key[0], "scenario_id": key[1], "k": k, "signal": s, "value": v}) for s, v in sorted(sim.items())]
        return pd.concat(parts)

    kinds = ", ".join(f"{c} {inputs.schema[c].dataType.simpleString()}" for c in ("plant_id", "scenario_id", "k"))
    return inputs.groupBy("plant_id", "scenario_id").applyInPandas(one, f"{kinds}, signal string, value double")


def simulate_single(model: Model, inputs: list[np.ndarray], dt: float, additive: list[np.ndarray] | None = None) -> np.ndarray:
    """One model by itself over its inputs, from a steady state."""
    model.reset()
    columns = [*inputs, *(additive or [])]
    return np.array([model.step([float(c[k]) for c in columns], dt)[0] for k in range(len(columns[0]))])


def feedback_loop(process: Model, pid: PidModel) -> Plant:
    """A PID that measures a process and sets its first input."""
    process.inputs[0] = pid.output
    pid.inputs[0] = process.output
    return Plant([pid, process])
