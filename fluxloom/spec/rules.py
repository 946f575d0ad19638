"""Rules over a batch of documents: ids, references, modes, target names, connector capabilities, expression types."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import types as T

from fluxloom.errors import Coded
from fluxloom.expressions import Scope
from fluxloom.operators.targets import Rename
from fluxloom.sources import connectors
from fluxloom.sources.tables import is_pattern
from fluxloom.spec.documents import Resource, probe_types


class Workspace:
    """A batch that passed every rule, in this order: duplicate ids, closure, modes, renames, capabilities."""

    def __init__(self, resources: Iterable[Resource]):
        self.resources = list(resources)
        self.by_id: dict[str, Resource] = {}
        for r in self.resources:
            if r.id in self.by_id:
                raise Coded("dsl.duplicate-id", id=r.id, path="id")
            self.by_id[r.id] = r
        for rule in (self._closure, self._modes, self._renames, self._capabilities):
            for r in self.resources:
                rule(r)

    def sources(self, p: Resource) -> list[Resource]:
        return [self.by_id[s] for s in p.body["source"] if s in self.by_id and self.by_id[s].kind == "source"]

    def universe(self, p: Resource) -> dict[str, tuple[set[str], bool]]:
        """Source id -> (literal tables, open): a source that selects all, or by pattern, may have any table."""
        out = {}
        for s in self.sources(p):
            names = [t["name"] if isinstance(t, dict) else str(t) for t in s.body.get("tables") or []]
            out[s.id] = ({n for n in names if not is_pattern(n)}, not names or any(map(is_pattern, names)))
        return out

    # --- closure
    def _closure(self, p: Resource) -> None:
        if p.kind != "pipeline":
            return
        view, serve, steps = p.body.get("view"), p.body.get("serve"), p.body["transforms"]
        if view is None and serve is None:
            raise Coded("dsl.composition", detail="a pipeline needs a view or a serve", path="")
        seen: set[str] = set()
        for path, name in self._internal(p):
            if name in seen:
                raise Coded("dsl.duplicate-id", id=name, path=path)
            seen.add(name)
        for s in p.body["source"]:
            if s not in self.by_id or self.by_id[s].kind != "source":
                raise Coded("dsl.missing-reference", ref=s, path="source")
        universe = self.universe(p)
        taken = set(universe) | {t for tables, _ in universe.values() for t in tables}
        for i, step in enumerate(steps):
            if step["id"] in taken:  # a bare reference could mean either
                raise Coded("dsl.duplicate-id", id=step["id"], path=f"transforms[{i}].id")
        ids = {s["id"] for s in steps}
        for i, step in enumerate(steps):
            for ref in step["from"].values() if isinstance(step["from"], dict) else step["from"]:
                self._resolve(str(ref), ids, universe, f"transforms[{i}].from")
            self._used(step, "transform", f"transforms[{i}].use")
        if view is not None:
            self._resolve(view["from"], ids, universe, "view.from")
            self._used(view, "view", "view.use")
        if serve is not None:
            self._resolve(serve["from"], ids | ({view["id"]} if view else set()), universe, "serve.from")
            self._used(serve, "serve", "serve.use")
            for part in ("sync", "push"):
                for i, e in enumerate(serve.get(part) or []):
                    if e.get("source") is not None and (e["source"] not in self.by_id or self.by_id[e["source"]].kind != "source"):
                        raise Coded("dsl.missing-reference", ref=e["source"], path=f"serve.{part}[{i}].source")

    def _internal(self, p: Resource) -> Iterator[tuple[str, str]]:
        for i, s in enumerate(p.body["transforms"]):
            yield f"transforms[{i}].id", s["id"]
        if p.body.get("view"):
            yield "view.id", p.body["view"]["id"]
        serve = p.body.get("serve") or {}
        if serve and "use" not in serve:
            yield "serve.id", serve["id"]
            for part in ("sync", "push"):
                for i, e in enumerate(serve.get(part) or []):
                    yield f"serve.{part}[{i}].id", e["id"]

    def _resolve(self, ref: str, ids: set[str], universe: Mapping[str, tuple[set[str], bool]], path: str) -> None:
        if is_pattern(ref) or ref in ids or ref in universe:
            return  # a pattern is a dynamic link and may match nothing yet
        owner, dot, table = ref.partition(".")
        if dot:
            if owner in universe and (universe[owner][1] or table in universe[owner][0]):
                return
            raise Coded("dsl.missing-reference", ref=ref, path=path)
        holders = sum(ref in tables for tables, _ in universe.values())
        if holders > 1:
            raise Coded("dsl.ambiguous-reference", ref=ref, path=path)
        if not holders and not any(is_open for _, is_open in universe.values()):
            raise Coded("dsl.missing-reference", ref=ref, path=path)

    def _used(self, block: dict, kind: str, path: str) -> None:
        if "use" in block and (block["use"] not in self.by_id or self.by_id[block["use"]].kind != kind):
            raise Coded("dsl.missing-reference", ref=block["use"], path=path)

    # --- modes
    def _modes(self, r: Resource) -> None:
        mismatch = lambda field, mode, path: Coded("dsl.mode-mismatch", field=field, mode=mode, path=path)
        if r.kind == "source" and r.body.get("srs") is not None and r.body.get("mode") != "cdc":
            raise mismatch("srs", r.body.get("mode") or "(none)", "srs")
        if r.kind != "pipeline":
            return
        settings, modes = r.body.get("settings") or {}, [s.body.get("mode") for s in self.sources(r)]
        once = settings.get("read_mode") == "snapshot_only"
        if once and "stream" in modes:
            raise mismatch("read_mode", "stream", "settings.read_mode")
        tail = "stream" if "stream" in modes else "cdc" if "cdc" in modes and not once else None
        if settings.get("start_from") is not None and tail is None:
            raise mismatch("start_from", "snapshot_only" if once and "cdc" in modes else next((m for m in modes if m), "(bounded)"), "settings.start_from")
        if settings.get("schedule") is not None and tail:
            raise mismatch("schedule", tail, "settings.schedule")

    # --- target names
    def _renames(self, p: Resource) -> None:
        if p.kind != "pipeline":
            return
        tables = sorted(t for names, _ in self.universe(p).values() for t in names)
        for i, sync in enumerate((p.body.get("serve") or {}).get("sync") or []):
            if sync.get("rename"):
                path = f"serve.sync[{i}].rename"
                rename = Rename(**{**sync["rename"], "map": dict(sync["rename"].get("map") or {})})
                for t, target in rename.map.items():
                    if not str(target or "").strip():
                        raise Coded("dsl.illegal-value", value=target, expected="a table name", path=f"{path}.map.{t}")
                claims: dict[str, str] = {}
                for t, target in rename.map.items():
                    if target in claims:
                        raise Coded("dsl.illegal-value", value=target, expected="one table per target", path=f"{path}.map.{t}")
                    claims[target] = t
                rename.check(dict.fromkeys(tables), path)

    # --- connectors
    def _capabilities(self, r: Resource) -> None:
        if r.kind == "source":
            connectors.check_source(r.body)
        if r.kind == "pipeline":
            for i, sync in enumerate((r.body.get("serve") or {}).get("sync") or []):
                target = self.by_id.get(sync.get("source"))
                if target is not None:
                    connectors.check_sink(target.body["connector"], sync.get("write_mode") or "upsert", f"serve.sync[{i}].write_mode")

    # --- expression types, once tables are discovered
    def check_types(self, p: Resource, models: Mapping[str, Mapping[str, T.StructType]]) -> None:
        """Type every expression against each table that reaches it, one table at a time, never a mixture.

        ``models``: source -> table -> row type; a source that is missing has not been discovered.
        """
        for i, step in enumerate(p.body["transforms"]):
            body = self.by_id[step["use"]].body if "use" in step else step
            exprs = [(body["expr"], f"transforms[{i}].expr")] if body.get("expr") else []
            exprs += [(r[1:], f"transforms[{i}].fields.{n}") for n, r in (body.get("fields") or {}).items() if isinstance(r, str) and r.startswith("=")]
            for expr, path in exprs:
                if not re.search(r"\b(after|before)\b", expr):
                    continue
                for source, table in self._reaching(p, step):
                    if source not in models:
                        raise Coded("dsl.row-expression-needs-discovery", expr=expr, source=source, path=path)
                    for name, row in models[source].items():
                        if table is None or name == table:
                            plain = Scope.envelope(T.StructType([]))
                            scope = Scope({"before": row, "after": row}, plain=plain.plain, now=plain.now)
                            try:
                                probe_types(expr, scope)
                            except Coded as e:
                                e.args_.update(table=name, path=path)
                                raise

    def _reaching(self, p: Resource, step: dict) -> list[tuple[str, str | None]]:
        """Source tables that reach a step directly; what other steps make of them is typed when the plan is built."""
        out: list[tuple[str, str | None]] = []
        steps, universe = {s["id"] for s in p.body["transforms"]}, self.universe(p)
        for ref in step["from"].values() if isinstance(step["from"], dict) else step["from"]:
            if ref in steps:
                continue
            owner, dot, table = ref.partition(".")
            if is_pattern(ref):
                out += [(s, None) for s in universe]
            elif ref in universe:
                out.append((ref, None))
            elif dot:
                out.append((owner, table))
            else:
                out += [(s, ref) for s, (names, is_open) in universe.items() if ref in names or is_open]
        return out
