"""The life of a draft with its rules: who may do what, what is logged, and confirmation of publishing and discarding.

Every step asks first whether the actor may take it; a refusal is logged as ``blocked`` and shows nothing of the
draft. Publishing and discarding take two calls: a preview that returns a token, and a confirmation. A token is bound to
the step, the namespace and the content of the draft with its configuration; one that was used stands in the
log, so it stays used after a restart. All state is in the store.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.jsontext import dumps
from weftgraph.operators import audit, lookup, overlay, profile, scope
from weftgraph.operators.mutate import Graph, Rejected, structural_errors
from weftgraph.operators.store import Store
from weftgraph.sources.numbered import Conflict

#: What the log keeps of a step; ``ids`` are the applies that it promoted or discarded, ``nonce`` the token's.
RECORD = (
    "id string, ts string, actor string, namespace string, eventType string, mutation string, reason string, baseVersion string, resultingVersion string, "
    "ids array<string>, selfAuthored boolean, nonce string, readQuery string, readCount bigint"
)
#: Longest text of a query in the log.
MOST_QUERY = 300


class Drafts:
    """Steps on the drafts of a store. ``roles`` has (userId, workspace, role); ``clock`` returns ISO text."""

    def __init__(self, store: Store, roles: DataFrame, clock: Callable[[], str], self_approval: bool = True):
        self.store, self.roles, self.clock, self.self_approval = store, roles, clock, self_approval

    # --- log ------------------------------------------------------------------------------------
    def log(self, namespace: str) -> DataFrame:
        """The records of a namespace; none where nothing was ever logged."""
        return self.store.audit(RECORD, namespace)

    def _write(self, actor: str, namespace: str, kind: str, ids: DataFrame | None = None, **fields) -> str:
        record = {"id": uuid.uuid4().hex, "ts": self.clock(), "actor": actor, "namespace": namespace, "eventType": kind} | fields
        names = [f.split()[0] for f in RECORD.split(", ")]
        row = self.store.spark.createDataFrame([tuple(record.get(n) for n in names)], RECORD)
        if ids is not None:  # the applies of one draft, each made by a person
            row = row.drop("ids").join(ids.agg(F.sort_array(F.collect_list("id")).alias("ids")))
        self.store.append_audit(row.select(*names))
        return record["id"]

    def _refused(self, actor: str | None, action: str, namespace: str) -> str | None:
        """Why an actor may not take a step; a refusal is logged."""
        asked = self.store.spark.createDataFrame([(actor, action, namespace.split("/")[0], actor is not None)], "userId string, action string, workspace string, known boolean")
        said = lookup.verdicts(asked, self.roles).first()
        if said.allowed:
            return None
        self._write(actor, namespace, "blocked", reason=f"unauthorized: {said.why}")
        return said.why

    # --- staging --------------------------------------------------------------------------------
    def stage(self, namespace: str, actor: str | None, mutation: str, change: Callable[[Graph], Graph]) -> dict:
        """Applies a change to the draft, which is opened by the first one; a change that breaks the graph is logged and not applied."""
        if why := self._refused(actor, "apply", namespace):
            return {"status": "unauthorized", "reason": why}
        seen = self.store.seen(namespace)
        base, slot = self.store.active(namespace)
        try:
            after = change(base)
            errors = structural_errors(self.store.published(namespace), after)
        except Rejected as e:
            errors = e.errors
        if errors:
            self._write(actor, namespace, "blocked", mutation=mutation, reason="; ".join(errors))
            return {"status": "blocked", "errors": errors}
        before = self.store.version(namespace)
        try:
            self.store.apply(namespace, after, seen)
        except Conflict:
            self._write(actor, namespace, "blocked", mutation=mutation, reason="the draft has moved")
            return {"status": "blocked", "errors": ["the draft has moved"]}
        if slot == "published":
            self._write(actor, namespace, "createDraft", baseVersion=before)
        now = self.store.version(namespace)
        return {"status": "applied", "id": self._write(actor, namespace, "apply", mutation=mutation, baseVersion=before, resultingVersion=now)}

    # --- reads that are logged --------------------------------------------------------------------
    def read_log(self, namespace: str, actor: str | None, cursor: tuple[str, str] | None = None, limit: int = audit.DEFAULT_PAGE, outcome: str | None = None, **conditions) -> dict:
        """A page of the log, newest first, for those who may read it; that it was read is logged after the page is taken.

        ``conditions``: event_type, actor_id, since and until, as in ``audit.matching``.
        """
        if why := self._refused(actor, "readAudit", namespace):
            return {"status": "unauthorized", "reason": why}
        if outcome not in (None, "applied", "blocked"):
            raise ValueError(f"unknown outcome {outcome!r}")
        asked = {k: v for k, v in (conditions | {"outcome": outcome}).items() if v is not None}

        def keep(rows: DataFrame) -> DataFrame:
            rows = audit.outcome(audit.matching(rows, event_type=conditions.get("event_type"), actor=conditions.get("actor_id")))
            return rows if outcome is None else rows.where(F.col("outcome") == outcome)

        page = [r.asDict(True) for r in self.store.audit_page(namespace, RECORD, limit, cursor, conditions.get("since"), conditions.get("until"), keep)]
        query = dumps(asked | ({"paged": True} if cursor else {}))
        self._write(actor, namespace, "read", readQuery=query if len(query) <= MOST_QUERY else query[: MOST_QUERY - 1] + "…", readCount=len(page))
        return {"status": "read", "records": page}

    def preview_course(self, namespace: str, actor: str | None, course: str) -> dict:
        """The nodes and edges of a course as the draft has them, as tables; that they were seen is logged."""
        if why := self._refused(actor, "readDraft", namespace):
            return {"status": "unauthorized", "reason": why}
        found = self.store.active(namespace)
        if found is None or found[1] != "draft":
            return {"status": "no draft"}
        part = scope.course_subgraph(*found[0], course)
        if part is None:
            return {"status": "not found"}
        version = self.store.version(namespace)
        self._write(actor, namespace, "preview", reason=f"course {course!r} of draft {version}")
        return {"status": "preview", "version": version, "nodes": part[0], "edges": part[1]}

    # --- profiles ---------------------------------------------------------------------------------
    def edit_profile(self, namespace: str, actor: str | None, proposed: dict, token: str | None = None, validate: profile.Validator | None = None) -> dict:
        """Replaces the profile of the draft, or of what is published without one, in two steps: a preview with a token, and its confirmation.

        Tokens are of profiles only and have no end of time; one is stale once the profile has changed. Of two writers one gets the change.
        """
        if why := self._refused(actor, "apply", namespace):
            return {"status": "unauthorized", "reason": why}
        if self.store.pointer(namespace) is None:
            return {"status": "failed", "reason": f"{namespace!r} is not seeded"}
        seen, now = self.store.seen(namespace), self.store.config(namespace)
        if token is None:
            shown = profile.preview(now, proposed, validate)
            if shown["status"] == "blocked":
                self._write(actor, namespace, "blocked", mutation="edit_profile", reason="; ".join(shown["errors"]))
            return shown
        try:
            said, record = profile.confirm(now, proposed, token, validate)
        except ValueError as e:
            said, record = str(e), None
        if record is None:
            return {"status": "failed", "reason": said}
        try:
            self.store.write_config(namespace, record, seen)
        except Conflict:
            return {"status": "failed", "reason": "the namespace has moved"}
        versions = {"baseVersion": profile.config_hash(now), "resultingVersion": profile.config_hash(record)}
        return {"status": "applied", "id": self._write(actor, namespace, "config", mutation="edit_profile", **versions)}

    # --- publishing and discarding ----------------------------------------------------------------
    def _print(self, namespace: str) -> str | None:
        """A digest of the draft, its base and its configuration; None without a draft."""
        p = self.store.pointer(namespace)
        if not p or not p["draft"]:
            return None
        versions = [self.store.version(namespace, published=True), self.store.version(namespace)]
        return hashlib.sha256(dumps([versions, p["config"], p["draft_config"]]).encode()).hexdigest()

    def preview(self, step: str, namespace: str, actor: str | None) -> dict:
        """What a step would change, and a token to confirm it; without a draft no token."""
        if why := self._refused(actor, step, namespace):
            return {"status": "unauthorized", "reason": why}
        found = self._print(namespace)
        if found is None:
            return {"status": "preview", "draft": False}
        p = self.store.pointer(namespace)
        counts = overlay.counts_of(self.store.difference(namespace)).first().asDict()
        token = dumps({"s": step, "w": namespace, "d": found, "n": uuid.uuid4().hex})
        return {"status": "preview", "draft": True, "counts": counts, "config_changed": p["config"] != p["draft_config"], "token": base64.urlsafe_b64encode(token.encode()).decode()}

    def confirm(self, step: str, namespace: str, actor: str | None, token: str | None) -> dict:
        """Takes the step, or says why not: no or another token, one that was used, or a draft that is gone or has moved."""
        if why := self._refused(actor, step, namespace):
            return {"status": "unauthorized", "reason": why}
        try:
            t = json.loads(base64.urlsafe_b64decode(token or ""))
            of_step, of_namespace, content, nonce = t["s"], t["w"], t["d"], t["n"]
        except (ValueError, KeyError, TypeError):
            return {"status": "failed", "reason": "malformed token" if token else "no token"}
        if of_step != step:
            return {"status": "failed", "reason": "token of another step"}
        if of_namespace != namespace:
            return {"status": "failed", "reason": "token of another namespace"}
        if self.log(namespace).where(F.col("nonce") == nonce).take(1):
            return {"status": "failed", "reason": "token used before"}
        now = self._print(namespace)
        if now != content:
            return {"status": "failed", "reason": "no draft" if now is None else "the draft has moved"}
        applies = audit.draft_applies(self.log(namespace)).select("id", "actor")
        own = applies.agg(F.coalesce(F.max(F.col("actor") == actor), F.lit(False)).alias("own")).first().own
        if step == "publish" and own and not self.self_approval:
            self._write(actor, namespace, "blocked", reason="unauthorized: own changes need another approver")
            return {"status": "failed", "reason": "own changes need another approver"}
        base = self.store.version(namespace, published=True)
        # The step comes first: a record of one that then failed could not be taken back.
        if step == "publish":
            result = self.store.version(namespace)
            self.store.publish(namespace)
            record = self._write(actor, namespace, "publish", applies, baseVersion=base, resultingVersion=result, selfAuthored=own, nonce=nonce)
        else:
            self.store.discard(namespace)
            record = self._write(actor, namespace, "discard", applies, baseVersion=base, nonce=nonce)
        return {"status": "done", "id": record, "self_authored": own}
