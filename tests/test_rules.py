from pyspark.sql import functions as F

from noticelake.operators import briefs, notices, rules

AS_OF = "2026-01-01"
FIELDS = "title string, description string, notice_type_en string, notice_type_fr string, procurement_category string, unspsc array<string>, close_at timestamp"


def decide(spark, **over):
    row = {"title": "", "description": "", "notice_type_en": "", "notice_type_fr": "", "procurement_category": "", "unspsc": [], "close_at": None} | over
    return rules.cascade(spark.createDataFrame([tuple(row.values())], FIELDS), F.lit(AS_OF).cast("timestamp")).first()


def test_non_it_is_rejected(spark):
    got = decide(spark, title="Road repair", description="asphalt", unspsc=["72141000"])
    assert "exclude_non_it_unspsc" in got["reject_reasons"] and got["reject_reason"] in rules.REASONS


def test_direct_is_kept(spark):
    got = decide(spark, title="S/4HANA upgrade", description="ABAP and Fiori work for an ERP")
    assert got["is_direct"] and got["reject_reasons"] == [] and got["rule_score"] >= 100


def test_portal_name_alone_is_not_direct(spark):
    assert not decide(spark, title="Office chairs", description="Submit bids on the Ariba Network supplier portal")["is_direct"]


def test_accents_and_apostrophes(spark):
    got = decide(spark, title="Mise en œuvre", description="Remplacement du système d’information et progiciel de gestion intégré")
    assert "progiciel de gestion integre" in got["domain_hits"] and "systeme d'information" in got["it_hits"]


def test_negative_title_and_award(spark):
    assert "exclude_negative_title" in decide(spark, title="Roof renovation")["reject_reasons"]
    assert decide(spark, title="ACAN for software", notice_type_en="Advance Contract Award Notice")["reject_reason"] == "exclude_award_notice"


def test_supply_arrangement_unless_against_one(spark):
    assert "exclude_supply_arrangement" in decide(spark, title="TBIPS resources")["reject_reasons"]
    assert "exclude_supply_arrangement" not in decide(spark, title="TBIPS ERP", notice_type_en="RFP against Supply Arrangement")["reject_reasons"]


def test_close_date_far_off(spark):
    import datetime

    far = datetime.datetime(2027, 1, 1)
    assert "exclude_far_future_close" in decide(spark, title="ERP upgrade", description="middleware", close_at=far)["reject_reasons"]


def test_threshold_and_rationale(spark):
    d = spark.createDataFrame([("ERP migration", "middleware", "", "", "", ["43210000"], None)], FIELDS)
    out = rules.final_score(rules.with_evidence(rules.cascade(d, F.lit(AS_OF).cast("timestamp")).withColumn("similarity", F.lit(0.5))))
    got = out.withColumn("why", rules.rationale(F.lit("AMS"), F.lit(0.5))).first()
    assert got["score"] >= 70 and got["reject_reason"] is None and got["why"] == "Rules: ERP domain (erp); Transform (migration, migration); UNSPSC IT; Allowlist (erp) | Semantic: AMS (sim 0.50)"


def test_notice_normalisation(spark):
    c = notices.SOURCE_COLUMNS
    row = {c["title_en"]: "Title", c["ref"]: "cb-1", c["amendment_number"]: "2", c["unspsc"]: "*43211500\n*81111500", c["published"]: "2026-01-02", c["amended"]: "2026-01-05", c["attachments"]: "https://a.b/x.pdf, https://a.b/x.pdf", c["status_en"]: "Open"}
    d = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row))
    got = notices.is_open(notices.normalize(d)).first()
    assert got["uid"] == "notices:cb-1:am2" and got["tender_key"] == "notices:cb-1" and got["unspsc"] == ["43211500", "81111500"]
    assert str(got["updated_at"]) == "2026-01-05 00:00:00" and got["attachments"] == ["https://a.b/x.pdf"] and len(got["attachment_hash"]) == 64


def test_briefs(spark):
    reply = 'Sure: {"opportunity_category": "erp upgrade", "SAP_solution_fit": {"fit": "Strong", "notes": ["x"]}, "stakeholder_entities": {"buyer_org": "City", "other_entities": ["A", "City", "A"]}, "timeline": {"milestones": ["m"]}, "key_requirements": ["provide S/4HANA", "cook lunch", "train users"], "recommended_next_step": "Decide"} done'
    d = spark.createDataFrame([(reply, "The supplier must provide S/4HANA and train users.", True), ("no json", "text", False)], "reply string, text string, hint boolean")
    a, b = briefs.normalize_brief(d, "reply", "text", F.col("hint")).select("brief.*").collect()
    assert (a["category"], a["fit"], a["confidence"], a["requirements"]) == ("ERP modernization", "strong", "medium", ["provide S/4HANA", "train users"])
    assert (a["summary"], a["stakeholders"]["other_entities"], a["fit_notes"]) == ("City: ERP modernization opportunity (SAP fit: strong). Key needs: provide S/4HANA, train users. Next: Decide. Confidence: medium.", ["A"], ["x"])
    assert (b["fit"], b["confidence"], b["requirements"]) == ("unknown", "low", [])


def test_terms_without_the_automaton(monkeypatch):
    from noticelake.plans import terms

    texts = ["sap and erp systems", "sapling", "an s/4hana erp", "accounts payable accounts payable", "", "hcm, hcm2 hcm"]
    fast = terms.TermScanner(terms.NOTICE_TERMS)
    expected = [fast.hits(t) for t in texts]
    monkeypatch.setattr(terms, "ahocorasick", None)
    slow = terms.TermScanner(terms.NOTICE_TERMS)
    assert [slow.hits(t) for t in texts] == expected and isinstance(slow.built(), terms.OneByOne) and expected[0]["direct"] == ["sap"]
