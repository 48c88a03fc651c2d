"""Reply checks, gaps and signals on small cases."""

from pyspark.sql import functions as F

from tidewater.operators import messages as M

REPLY = "Hola, de la cuota de tu plan te informamos que ya fue recibida {0} y que revisamos el pago"


def _checked(spark, extra, message="mi pago"):
    replies = spark.createDataFrame([(1, REPLY.format(extra), message, ["s1"], ["s1"], None)], "id int, reply string, message string, citations array<string>, allowed array<string>, document_number string")
    return M.reply_checks(replies, spark.createDataFrame([("s1", "plan de 3 cuotas")], "section_id string, body string")).first()


def test_numbers_in_words(spark):
    assert not _checked(spark, "por segunda vez")["numbers_ok"]
    assert _checked(spark, "por segunda vez", "llevo dos días esperando")["numbers_ok"]
    assert _checked(spark, "en tres cuotas")["numbers_ok"] and _checked(spark, "desde el primer día, los dos")["numbers_ok"]


def test_language_and_placeholders(spark):
    assert _checked(spark, "hoy")["language_ok"] and not _checked(spark, "Thanks")["language_ok"]
    assert _checked(spark, "del todo")["no_placeholders_ok"]
    assert not any(_checked(spark, left)["no_placeholders_ok"] for left in ("TODO", "XXX", "<b", "{nombre}"))
    assert not _checked(spark, "y envíanos tu clave")["forbidden_phrases_ok"]


def test_gaps_open_cases(spark):
    rows = [
        (1, "metodos_de_pago", "puedo pagar por Nequi?", "auto_reply", "none", "llm"), (2, "metodos_de_pago", "por PSE", "auto_reply", "none", "llm"),
        (3, "metodos_de_pago", "link de pago", "auto_reply", "none", "none"), (4, "cuenta_y_app", "olvide la CONTRASEÑA", "route_to_human", "soporte_tecnico", "none"),
    ]
    df = spark.createDataFrame(rows, "id int, final_reason string, text string, action string, queue string, reply_source string")
    df = df.withColumn("default_queue", F.col("queue")).withColumn("codes", F.array().cast("array<string>"))
    got = {r["id"]: (r["action"], r["queue"], r["codes"]) for r in M.gap_routed(df).collect()}
    assert got == {
        1: ("auto_reply_and_route", "cx_general", ["KNOWN_GAP", "GAP_ROUTED"]), 2: ("auto_reply", "none", []),
        3: ("auto_reply", "none", ["KNOWN_GAP"]), 4: ("route_to_human", "soporte_tecnico", ["KNOWN_GAP"]),
    }


def test_signals_and_topics(spark):
    texts = ["GRITO URGENTE", "debo 123456 hoy", "12345 6", "xyz", None, ""]
    df = spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(texts)], "id string, text string")
    got = {r["signal"]: (r["n"], r["example"]) for r in M.signal_counts(df).collect()}
    assert got["urgency words"] == (1, "m0") and got["capitals"] == (1, "m0") and got["amount mentioned"] == (1, "m1") and got["password mentioned (KB: login is document + OTP)"] == (0, None)
    assert M.signal_counts(df.where("false")).where("n = 0 and example is null").count() == len(got)
    assert [r[0] for r in df.select(M.topic(F.coalesce("text", F.lit("")))).distinct().collect()] == ["(no keyword match)"]


def test_sections_are_united_in_order(spark):
    rows = [("a", "mora_intereses", ["reporte_centrales", "mora_intereses"], None), ("b", "queja_reclamo", [], "OVR_LEGAL"), ("c", "cancelacion", None, "OVR_LEGAL"), ("d", "no_such_reason", ["ruido"], None)]
    found = M.allowed_sections(spark.createDataFrame(rows, "id string, final_reason string, final_secondary array<string>, override string"))
    assert {r["id"]: r["allowed"] for r in found.collect()} == {
        "a": ["mora_y_centrales.mora_e_intereses", "mora_y_centrales.reporte_centrales", "mora_y_centrales.paz_y_salvo"], "b": ["datos_certificados_pqr.pqr"],
        "c": ["datos_certificados_pqr.cancelacion", "pagos_y_cuotas.pago_anticipado", "datos_certificados_pqr.pqr"], "d": [],
    }


def test_uncovered_points_open_a_case(spark):
    good = dict.fromkeys((f"{c}_ok" for c in M.CHECKS), True)
    rows = [
        {"id": "sent", **good, "can_answer": True, "uncovered": None}, {"id": "partly", **good, "can_answer": True, "uncovered": "hours"},
        {"id": "failed", **good, "numbers_ok": False, "can_answer": True, "uncovered": "hours"}, {"id": "unable", **good, "can_answer": False, "uncovered": ""},
    ]
    schema = "id string, " + ", ".join(f"{c}_ok boolean" for c in M.CHECKS) + ", can_answer boolean, uncovered string"
    got = {r["id"]: (r["reply_codes"], r["final_action"], r["policy_gap"]) for r in M.reply_outcome(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()}
    assert got == {
        "sent": (["DRAFT_VERIFIED"], "auto_reply", None), "partly": (["DRAFT_VERIFIED", "GAP_ROUTED"], "auto_reply_and_route", "hours"),
        "failed": (["VERIFIER_NUMBERS"], "route_to_human", None), "unable": (["DRAFT_NOT_ANSWERABLE"], "route_to_human", "The allowed sections do not answer the request."),
    }


def test_lengths_by_place_in_order(spark):
    rows = [("a" if i % 3 else "b", "x" * i) for i in range(1, 31)]
    got = {r["channel"]: tuple(r)[1:] for r in M.length_profile(spark.createDataFrame(rows, "channel string, text string")).collect()}
    expected = {}
    for name in ("a", "b", "(all)"):
        lens = sorted(len(t) for c, t in rows if name in (c, "(all)"))
        expected[name] = (len(lens), lens[0], lens[len(lens) // 2], lens[int(len(lens) * 0.9)], lens[-1])
    assert got == expected
