"""Citizen, review, chat and store queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators import chat, citizens, reviews
from tallymark.operators.conflicts import rolling_state, with_conflict
from tallymark.operators.search import citizen_queue
from tallymark.plans.check_sql import ROLLING_VIEWS
from tallymark.plans.registry import query
from tallymark.session import shared_folder
from tallymark.sources import documents, evidence, stores
from tallymark.sources.fixtures import Tables

CLAIM_VIEWS = {
    "e_claims": """SELECT *, claim IS NOT NULL AS has_claim, claim IS NOT NULL AND EXISTS (
        SELECT 1 FROM v_violations v WHERE v.scan_id = c.scan_id AND (
          (claim LIKE '%mrp%' AND v.field_name LIKE '%mrp%') OR (claim LIKE '%font%' AND v.violation_type LIKE '%font%')
          OR (claim LIKE '%origin%' AND v.field_name LIKE '%origin%')
          OR contains(v.violation_type, claim) OR contains(v.field_name, claim))) AS claim_verified
      FROM (SELECT *, nullif(replace(replace(lower(trim(claimed_violation_type)), '-', '_'), ' ', '_'), '') AS claim
            FROM v_scans WHERE user_role = 'citizen') c""",
    "e_xp": """SELECT user_id, scan_id, created_at, compliance_status,
        CASE WHEN tampered THEN -100 WHEN has_claim AND claim_verified THEN 50 WHEN has_claim THEN -25
             WHEN compliance_status = 'non_compliant' THEN 20 ELSE 0 END AS xp_change,
        CASE WHEN tampered THEN 'tampering_detected' WHEN has_claim AND claim_verified THEN 'violation_confirmed' WHEN has_claim THEN 'claim_refuted'
             WHEN compliance_status = 'non_compliant' THEN 'violation_confirmed' ELSE 'system_notice' END AS notification_type
      FROM e_claims""",
    "e_balance": """SELECT u.user_id, u.user_role, CAST(100 + coalesce(x.s, 0) AS BIGINT) AS xp FROM (SELECT DISTINCT user_id, user_role FROM v_scans) u
        LEFT JOIN (SELECT user_id, sum(xp_change) AS s FROM e_xp GROUP BY 1) x USING (user_id)""",
}


def events(t: Tables) -> DataFrame:
    return citizens.xp_events(citizens.verify_claims(t.scans, t.violations))


def balances(t: Tables) -> DataFrame:
    return citizens.user_balances(t.scans.select("user_id", "user_role").distinct(), events(t))


@query("claim_verification", "SELECT scan_id, has_claim, claim_verified FROM e_claims", CLAIM_VIEWS)
def claim_verification(t: Tables) -> DataFrame:
    return citizens.verify_claims(t.scans, t.violations).select("scan_id", "has_claim", "claim_verified")


@query(
    "xp_running_balance",
    """SELECT user_id, scan_id, CAST(xp_change AS BIGINT) AS xp_change, notification_type,
      CAST(100 + sum(xp_change) OVER (PARTITION BY user_id ORDER BY created_at, scan_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS xp FROM e_xp""",
    CLAIM_VIEWS,
)
def xp_running_balance(t: Tables) -> DataFrame:
    citizen_scans = t.scans.where(F.col("user_role") == "citizen").select("user_id")
    return citizens.xp_balance(events(t), sizes=citizen_scans).select("user_id", "scan_id", "xp_change", "notification_type", "xp")


@query(
    "user_reputation",
    """SELECT user_id, user_role, xp, CASE WHEN xp >= 500 THEN 'Master Metrologist' WHEN xp >= 200 THEN 'Vigilant Citizen'
      WHEN xp >= 50 THEN 'Citizen Scout' WHEN xp >= 0 THEN 'Probationary Citizen' ELSE 'Restricted Submitter' END AS reputation_tier FROM e_balance""",
    CLAIM_VIEWS,
)
def user_reputation(t: Tables) -> DataFrame:
    return balances(t)


@query(
    "submission_gate",
    "SELECT scan_id, user_id FROM v_submissions WHERE user_id NOT IN (SELECT user_id FROM e_balance WHERE xp < 0)",
    CLAIM_VIEWS,
)
def submission_gate(t: Tables) -> DataFrame:
    return citizens.admit(t.submissions.select("scan_id", "user_id"), balances(t))


@query(
    "user_notifications",
    """SELECT user_id, scan_id, notification_type, recency, read_asked AS is_read FROM (
      SELECT *, xp_change = 0 AS read_asked, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, scan_id DESC) AS recency FROM e_xp)
    WHERE recency <= 50""",
    CLAIM_VIEWS,
)
def user_notifications(t: Tables) -> DataFrame:
    made = events(t).withColumn("is_read", F.lit(False))
    asked = made.where(F.col("xp_change") == 0).select("user_id", "scan_id")
    latest = citizens.latest_notifications(citizens.mark_read(made, asked))
    return latest.select("user_id", "scan_id", "notification_type", "recency", "is_read")


@query(
    "citizen_queue",
    """SELECT s.scan_id, s.user_id, b.xp AS submitter_xp FROM v_scans s JOIN e_balance b USING (user_id)
    WHERE s.user_role = 'citizen' AND b.xp < 0 AND (lower(coalesce(product_name, '')) LIKE '%pack%' OR lower(category) LIKE '%pack%' OR gtin LIKE '%pack%')""",
    CLAIM_VIEWS,
)
def citizen_queue_query(t: Tables) -> DataFrame:
    known = balances(t).select("user_id", F.col("xp").alias("submitter_xp"))
    rows = t.scans.join(known, "user_id", "left").withColumn("source", F.lit("inspector"))
    return citizen_queue(rows, "flagged", "Pack").select("scan_id", "user_id", "submitter_xp")


@query(
    "auto_report_triage",
    """SELECT scan_id, new_confidence, CASE WHEN conflict_type IS NULL AND new_confidence >= 0.70 THEN 'auto_report' ELSE 'manual_review' END AS handling
    FROM e_kinds WHERE user_role = 'citizen'""",
    ROLLING_VIEWS,
)
def auto_report_triage(t: Tables) -> DataFrame:
    return citizens.triage(with_conflict(rolling_state(t.scans))).select("scan_id", "new_confidence", "handling")


@query(
    "tamper_audit",
    """SELECT page_id AS file_id, sha256(html) AS server_sha256, CASE WHEN page_id % 5 = 0 THEN NULL WHEN contains(url, '?') THEN sha256(url) ELSE sha256(html) END AS client_sha256,
      CASE WHEN page_id % 5 = 0 THEN 'unchecked' WHEN contains(url, '?') THEN 'tampered' ELSE 'verified' END AS integrity FROM pages""",
)
def tamper_audit(t: Tables) -> DataFrame:
    pages = t.read("pages").withColumnRenamed("page_id", "file_id")
    sent = F.when(F.contains("url", F.lit("?")), F.sha2("url", 256)).otherwise(F.upper(F.sha2("html", 256)))
    manifest = pages.select("file_id", F.when(F.col("file_id") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), sent)).alias("client_sha256"))
    return citizens.tamper_audit(manifest, pages, F.col("html"))


# Evidence files: the pages as files of a store; what was sent is known from the pages, what lies there is altered for some of them.
FILE_VIEWS = {
    "e_files": """SELECT page_id AS file_id, html || CASE WHEN page_id % 11 = 4 THEN '<!-- changed -->' ELSE '' END || chr(10) AS body FROM pages WHERE page_id % 13 <> 5""",
    "e_manifest": """SELECT page_id AS file_id, strlen(html) + 1 AS announced_bytes, CASE WHEN page_id % 7 <> 3 THEN sha256(html || chr(10)) END AS client_sha256 FROM pages WHERE page_id % 17 <> 6""",
}


def evidence_files(t: Tables) -> DataFrame:
    """The pages written as files and read back as bytes."""
    folder = f"{shared_folder(t.spark)}/evidence-{uuid.uuid4().hex}"
    pages = t.pages.where("page_id % 13 <> 5")
    changed = F.concat("html", F.when(F.col("page_id") % 11 == 4, "<!-- changed -->").otherwise(""))
    evidence.write_files(pages, folder, "page_id", changed)
    return evidence.read_files(t.spark, folder)


@query(
    "evidence_audit",
    """SELECT file_id, announced_bytes, strlen(body) AS n_bytes, client_sha256, sha256(body) AS server_sha256,
      CASE WHEN m.file_id IS NULL THEN 'unlisted' WHEN body IS NULL THEN 'missing' WHEN client_sha256 IS NULL THEN 'unchecked' WHEN client_sha256 = sha256(body) THEN 'verified' ELSE 'tampered' END AS integrity
    FROM e_files f FULL JOIN e_manifest m USING (file_id)""",
    FILE_VIEWS,
)
def evidence_audit(t: Tables) -> DataFrame:
    sent = F.concat("html", F.lit("\n"))
    announced = t.pages.where("page_id % 17 <> 6").select(
        F.col("page_id").alias("file_id"),
        F.octet_length(sent).cast("long").alias("n_bytes"),
        F.when(F.col("page_id") % 7 == 3, " ").otherwise(F.concat(F.lit(" "), F.upper(F.sha2(sent, 256)))).alias("client_sha256"),
    )
    return evidence.audit(announced, evidence_files(t))


@query(
    "repeated_evidence",
    "SELECT sha256(body) AS sha256, count(*) AS n_files, min(file_id) AS first_file_id FROM (SELECT file_id % 9 AS k, file_id, body FROM e_files UNION ALL SELECT file_id % 9, file_id + 1000000, body FROM e_files WHERE file_id % 9 = 2) GROUP BY 1 HAVING count(*) > 1",
    FILE_VIEWS,
)
def repeated_evidence(t: Tables) -> DataFrame:
    """Every ninth file counts a second time, under another id; each file is opened and hashed once."""
    files, own = evidence_files(t), F.col("file_id")
    ids = F.when(own % 9 == 2, F.array(own, own + 1_000_000)).otherwise(F.array(own))
    return evidence.repeated_content(files.withColumn("file_id", F.explode_outer(ids)))


# Reviews: every part-order line of a scan is read as one inspector review of it.
REVIEW_VIEWS = {
    "e_reviews": """SELECT o_orderkey AS review_id, o_custkey AS scan_id, concat('inspector ', o_orderpriority) AS inspector, o_orderdate AS reviewed_at,
        CASE o_orderstatus WHEN 'F' THEN 'Non-Compliant' WHEN 'O' THEN 'COMPLIANT' ELSE '' END AS verdict_override FROM orders""",
}


def review_rows(t: Tables) -> DataFrame:
    return t.read("orders").select(
        F.col("o_orderkey").alias("review_id"),
        F.col("o_custkey").alias("scan_id"),
        F.concat(F.lit("inspector "), "o_orderpriority").alias("inspector"),
        F.col("o_orderdate").alias("reviewed_at"),
        F.when(F.col("o_orderstatus") == "F", "Non-Compliant")
        .when(F.col("o_orderstatus") == "O", "COMPLIANT")
        .otherwise("")
        .alias("verdict_override"),
    )


@query(
    "reviewed_scans",
    """SELECT s.scan_id, coalesce(r.v, s.compliance_status) AS compliance_status, r.inspector AS reviewed_by FROM v_scans s LEFT JOIN (
      SELECT scan_id, replace(lower(verdict_override), '-', '_') AS v, inspector FROM e_reviews WHERE verdict_override <> ''
      QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY reviewed_at DESC, review_id DESC) = 1) r USING (scan_id)""",
    REVIEW_VIEWS,
)
def reviewed_scans(t: Tables) -> DataFrame:
    return reviews.apply_verdicts(t.scans, review_rows(t)).select("scan_id", "compliance_status", "reviewed_by")


@query(
    "review_audit_log",
    """SELECT scan_id, inspector AS username, 'INSPECTOR_REVIEW' AS action, s.compliance_status AS old_value,
      coalesce(nullif(verdict_override, ''), s.compliance_status) AS new_value, reviewed_at AS logged_at
    FROM e_reviews JOIN v_scans s USING (scan_id)""",
    REVIEW_VIEWS,
)
def review_audit_log(t: Tables) -> DataFrame:
    return reviews.review_audit(t.scans, review_rows(t))


@query(
    "reviewed_fields",
    """SELECT v.scan_id, v.field_name, CASE WHEN r.scan_id IS NULL THEN v.violation_type ELSE r.new_value END AS extracted_value,
      CASE WHEN r.scan_id IS NULL THEN 'ocr' ELSE 'inspector_override' END AS extraction_method, CASE WHEN r.scan_id IS NULL THEN 0.8 ELSE 1.0 END AS confidence
    FROM (SELECT DISTINCT scan_id, field_name, first_value(violation_type) OVER (PARTITION BY scan_id, field_name ORDER BY violation_type) AS violation_type FROM v_violations) v
    LEFT JOIN (SELECT o_custkey AS scan_id, CASE WHEN o_orderstatus = 'F' THEN 'net_quantity' ELSE 'mrp' END AS field_name, 'value ' || CAST(o_orderkey AS VARCHAR) AS new_value
      FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) r
    ON r.scan_id = v.scan_id AND r.field_name = v.field_name""",
)
def reviewed_fields(t: Tables) -> DataFrame:
    declared = t.violations.groupBy("scan_id", "field_name").agg(F.min("violation_type").alias("extracted_value"))
    declared = declared.withColumns({"extraction_method": F.lit("ocr"), "confidence": F.lit(0.8)})
    told = t.read("orders").select(
        F.col("o_orderkey").alias("review_id"),
        F.col("o_custkey").alias("scan_id"),
        F.col("o_orderdate").alias("reviewed_at"),
        F.when(F.col("o_orderstatus") == "F", "net_quantity").otherwise("mrp").alias("field_name"),
        F.concat(F.lit("value "), F.col("o_orderkey").cast("string")).alias("new_value"),
    )
    return reviews.apply_fields(declared, told)


@query(
    "chat_history",
    """SELECT conv_id, turn, role, text, position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations)
    WHERE position <= 50""",
)
def chat_history(t: Tables) -> DataFrame:
    return chat.chat_history(t.read("conversations"))


def _intent_sql() -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(trim(text)), '{w}')" for w in words) + f" THEN '{intent}'"
        for intent, words in chat.INTENT_WORDS.items()
    )
    return f"SELECT role, CASE {cases} ELSE 'default' END AS intent, count(*) AS message_count FROM conversations GROUP BY 1, 2"


@query("chat_intent_mix", _intent_sql())
def chat_intent_mix(t: Tables) -> DataFrame:
    return chat.intent_mix(t.read("conversations"))


NORMAL_VIEW = {
    "e_normal": """SELECT scan_id, scan_uid, coalesce(nullif(product_name, ''), nullif(product_title, ''), nullif(details_name, ''), 'Packaged Commodity Product') AS product_name,
      coalesce(nullif(product_category, ''), nullif(category, ''), 'Packaged Foods') AS category, coalesce(scan_type, 'manual') AS scan_type,
      replace(lower(coalesce(nullif(compliance_status, ''), nullif(final_result, ''), 'non_compliant')), '-', '_') AS compliance_status,
      CAST(coalesce(nullif(overall_confidence, 0), nullif(compliance_confidence, 0), nullif(ocr_confidence, 0), 0.85) AS DOUBLE) AS confidence_score,
      coalesce(nullif(scanned_image_url, ''), nullif(gallery_url, ''), '') AS image_url, created_at FROM v_submissions""",
}


@query("stored_scans", "SELECT * FROM e_normal", NORMAL_VIEW)
def stored_scans(t: Tables) -> DataFrame:
    return stores.normalise_scans(t.submissions)


@query(
    "creation_audit_page",
    """SELECT scan_id, compliance_status AS new_value, scan_type || ' scan: ' || product_name AS reason, created_at AS logged_at
    FROM e_normal ORDER BY created_at DESC, scan_id DESC LIMIT 50""",
    NORMAL_VIEW,
)
def creation_audit_page(t: Tables) -> DataFrame:
    keyed = stores.normalise_scans(t.submissions).withColumn("scan_uid", F.lpad(F.col("scan_id").cast("string"), 12, "0"))
    newest = stores.audit_page(stores.creation_audit(keyed))
    return newest.select(F.col("scan_uid").cast("long").alias("scan_id"), "new_value", "reason", "logged_at")


@query(
    "assigned_scan_uids",
    """SELECT scan_id, CASE WHEN scan_id_text LIKE 'LM-2026-%' THEN scan_id_text WHEN scan_uid <> '' THEN scan_uid
      ELSE 'LM-2026-' || lpad(CAST(n AS VARCHAR), CAST(greatest(6, length(CAST(n AS VARCHAR))) AS INT), '0') END AS scan_uid FROM (
      SELECT *, 500 + row_number() OVER (PARTITION BY (scan_id_text LIKE 'LM-2026-%' OR coalesce(scan_uid, '') <> '') ORDER BY created_at, scan_id) AS n FROM v_submissions)""",
)
def assigned_scan_uids(t: Tables) -> DataFrame:
    minute = F.left(F.col("created_at").cast("string"), F.lit(16))
    slim = t.submissions.select("scan_id", "scan_id_text", "scan_uid", "created_at")
    return stores.assign_uids(slim, 500, ["created_at", "scan_id"], minute).select("scan_id", "scan_uid")


@query(
    "ledger_keys",
    """SELECT scan_id, coalesce(CASE WHEN scan_type <> 'manual' THEN gtin END,
      CASE WHEN user_role = 'citizen' THEN 'CITIZEN-' || lpad(CAST(scan_id AS VARCHAR), CAST(greatest(6, length(CAST(scan_id AS VARCHAR))) AS INT), '0') END) AS ledger_key FROM v_scans""",
)
def ledger_keys(t: Tables) -> DataFrame:
    code = F.when(F.col("scan_type") == "manual", "  ").otherwise(F.concat(F.lit(" "), "gtin"))
    return t.scans.select("scan_id", stores.ledger_key(code, F.col("user_role"), F.col("scan_id")).alias("ledger_key"))


@query(
    "verification_upsert",
    """SELECT o_custkey AS verification_key, o_orderkey AS profile_id, o_orderdate AS saved_at FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderstatus = 'F' DESC, o_orderkey DESC) = 1""",
)
def verification_upsert(t: Tables) -> DataFrame:
    saved = t.read("orders").select(
        F.col("o_custkey").alias("verification_key"),
        F.col("o_orderkey").alias("profile_id"),
        F.col("o_orderdate").alias("saved_at"),
        "o_orderstatus",
    )
    new, old = saved.where(F.col("o_orderstatus") == "F"), saved.where(F.col("o_orderstatus") != "F")
    return stores.upsert(old, new, "verification_key", "saved_at", "profile_id").drop("o_orderstatus")


@query(
    "chat_session_insert",
    """SELECT conv_id AS session_id, min(turn) AS first_turn FROM conversations
    WHERE conv_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1""",
)
def chat_session_insert(t: Tables) -> DataFrame:
    new = t.read("conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("first_turn"))
    old = t.read("labels").select(F.col("doc_id").alias("session_id"))
    return stores.insert_absent(old, new, "session_id", "first_turn")


# Stored documents: every scan as JSON text. The fixture breaks one document in ten (it lacks its last character),
# so that the fall back to flat columns is met.
BROKEN_EVERY = 10


def bronze(t: Tables) -> DataFrame:
    mrp = F.struct(
        F.concat(F.lit("MRP Rs. "), "gtin").alias("extracted_value"),
        F.lit("ocr_proximity").alias("extraction_method"),
        F.col("confidence").cast("double").alias("confidence"),
    )
    fault = F.struct(F.lit("mrp").alias("field_name"), F.lit("missing").alias("violation_type"), F.lit("high").alias("severity"))
    whole = F.to_json(
        F.struct(
            "product_name",
            F.col("category").alias("product_category"),
            "scan_type",
            "compliance_status",
            F.create_map(F.lit("mrp"), mrp).alias("fields"),
            F.when(F.col("compliance_status") == "non_compliant", F.array(fault)).otherwise(F.array()).alias("violations"),
        )
    )
    return t.scans.select(
        "scan_id",
        "scan_uid",
        F.lit("flat name").alias("product_name"),
        F.lit("flat category").alias("product_category"),
        "scan_type",
        F.lit("partial_review_needed").alias("compliance_status"),
        F.lit(7).alias("violations_count"),
        F.when(F.col("scan_id") % BROKEN_EVERY == 3, F.left(whole, F.length(whole) - 1)).otherwise(whole).alias("raw_data"),
    )


@query(
    "document_scans",
    """SELECT scan_id, scan_uid, CASE WHEN scan_id % 10 = 3 THEN 'flat name' ELSE coalesce(product_name, 'flat name') END AS product_name,
      CASE WHEN scan_id % 10 = 3 THEN 'flat category' ELSE category END AS product_category, scan_type,
      CASE WHEN scan_id % 10 = 3 THEN 'partial_review_needed' ELSE compliance_status END AS compliance_status, 'inspector' AS source,
      scan_id % 10 = 3 AS from_flat_columns,
      CASE WHEN scan_id % 10 = 3 THEN 7 WHEN compliance_status = 'non_compliant' THEN 1 ELSE 0 END AS violations_count FROM v_scans""",
)
def document_scans(t: Tables) -> DataFrame:
    return documents.scans_of(documents.open_documents(bronze(t)))


@query(
    "document_fields",
    """SELECT scan_id, 'mrp' AS field_name, 'MRP Rs. ' || gtin AS extracted_value, 'ocr_proximity' AS extraction_method, CAST(confidence AS DOUBLE) AS confidence
    FROM v_scans WHERE scan_id % 10 <> 3""",
)
def document_fields(t: Tables) -> DataFrame:
    return documents.fields_of(documents.open_documents(bronze(t)))


@query(
    "document_violations",
    """SELECT scan_id, 'mrp' AS field_name, 'missing' AS violation_type, 'high' AS severity FROM v_scans
    WHERE scan_id % 10 <> 3 AND compliance_status = 'non_compliant'""",
)
def document_violations(t: Tables) -> DataFrame:
    return documents.violations_of(documents.open_documents(bronze(t)))


@query(
    "verification_profiles",
    """SELECT 'LM-VERIFY-2026-' || replace(replace(s.scan_uid, 'LM-', ''), '2026-', '') AS verification_id, s.scan_uid,
      coalesce(s.product_name, 'Packaged Commodity') AS product_name,
      CASE WHEN s.compliance_status = 'compliant' THEN 'COMPLIANT' WHEN s.compliance_status LIKE '%partial%' THEN 'PARTIALLY COMPLIANT' ELSE 'NON-COMPLIANT' END AS status_label,
      CASE WHEN s.compliance_status = 'compliant' THEN 100 ELSE greatest(10, 100 - 20 * coalesce(v.n, 0)) END AS compliance_score,
      coalesce(v.n, 0) AS violations_count, 'India' AS country_of_origin, s.created_at AS inspected_at
    FROM v_scans s LEFT JOIN (SELECT scan_id, count(*) AS n FROM v_violations GROUP BY 1) v USING (scan_id)""",
)
def verification_profiles(t: Tables) -> DataFrame:
    from tallymark.operators.profiles import public_profiles

    named = t.scans.withColumn("country_of_origin", F.lit(""))
    profiles = public_profiles(named, t.violations)
    return profiles.select(
        "verification_id", "scan_uid", "product_name", "status_label", "compliance_score", "violations_count",
        "country_of_origin", "inspected_at",
    )
