"""Fixed values of the message rules: word lists, patterns and policy tables."""

from __future__ import annotations

#: Words of greetings and of thanks.
GREETING = (
    "hola", "holaa", "holaaa", "buenas", "buenos", "dias", "tardes", "noches", "buen", "dia", "hey", "que", "tal", "saludos",
)
THANKS = (
    "ok", "oki", "okey", "listo", "vale", "gracias", "muchas", "todo", "bien", "perfecto", "genial", "super", "ya", "quedo", "resuelto", "lo", "de", "ayer", "hoy", "entendido", "dale",
)

#: Praise, and words of a test message.
PRAISE = r"amable|excelente|felicit|agradec\w*\s+(?:a|al|la|el)|muy buen[ao]|s[uú]per bien|sigan as[ií]|me ayud[oó]|me atendi[oó]|r[aá]pid[oa]|f[aá]cil de usar|cliente fiel"
TEST_WORDS = r"\b(?:probando|prueba|test|testing|123)\b"

#: Patterns of the eight message flags.
FLAGS = {
    "requests_human": r"(?:asesor|agente|persona|alguien|humano)\s+(?:humano|real|de verdad)|hablar (?:con|directamente con) (?:un asesor|un agente|una persona|alguien|un humano)|(?:pasar|comunicar|comuniquen)(?:me)? con (?:un asesor|un agente|alguien|una persona)|no (?:con|quiero) (?:el|al) bot|el bot no|robot no|chat(?:bot| autom[aá]tico) no|hay alguien ah[ií]|respuestas autom[aá]ticas|me pasan (?:un|con un) asesor",
    "fraud_or_security": r"phishing|estafa|fraude|suplantaci|hackea|clonaron|robaron (?:el|mi) celular|perd[ií] (?:el|mi) celular|me robaron\b|no reconozco (?:una|un|esa|ese)|(?:compra|cobro|cr[eé]dito|desembolso) (?:a cuotas )?(?:que|q) (?:yo )?no (?:hice|saqu[eé]|autoric[eé]|ped[ií])|usaron mi(?:s datos| identidad)|movimientos raros|mensaje (?:raro|falso|sospechoso)|link raro|sms raro|correo sospechoso",
    "legal_threat": r"superintendencia|abogad[oa]|demanda|denunci|defensor[ií]a del consumidor|acci[oó]n legal",
    "collections_harassment": r"\bacoso\b|me llaman (?:todo el d[ií]a|todos los d[ií]as|a toda hora)|llamando a mis familiares|dejen de llamar|tanto(?:s)? (?:llamada|mensaje)s? de cobranza",
    "vulnerable_customer": r"sin (?:trabajo|empleo)|perd[ií] (?:el|mi) trabajo|me qued[eé] sin (?:trabajo|empleo)|hospitaliz|estoy enferm[oa]|gastos m[eé]dicos|mi (?:mam[aá]|pap[aá]|hij[oa]) est[aá] (?:hospitaliz|enferm)|situaci[oó]n (?:econ[oó]mica )?(?:dif[ií]cil|complicada)",
    "imminent_deadline": r"vence ma[nñ]ana|ma[nñ]ana (?:se )?vence|se vence ma[nñ]ana|hoy (?:se )?vence|por ser reportad|(?:no|nunca) (?:quiero|vayan a) (?:q(?:ue)? )?me reporten|antes de que me reporten",
    "repeat_contact": r"tercera vez|segunda vez|cuarta vez|otra vez (?:escribo|les escribo)|llevo \d+ (?:d[ií]as|semanas) (?:llamando|escribiendo|esperando)|desde hace \d+ d[ií]as y nada|nadie me (?:resuelve|responde|contesta)|ya (?:hab[ií]a )?escrit[oa]",
    "prompt_injection_suspected": r"ignor[ae] (?:las|tus|todas las) (?:instrucciones|reglas)|olvida (?:las|tus) (?:reglas|instrucciones)|act[uú]a como|eres (?:ahora )?un[a]? (?:asistente|modelo|ia)|system prompt|prompt del sistema|revela (?:tu|el) prompt|muestra (?:tu|el) prompt|jailbreak|responde (?:solo )?con tu configuraci[oó]n|instrucci[oó]n del sistema|developer mode|modo desarrollador",
}

#: Entity patterns; the wanted text is group 1, or 0 where there is no group.
CREDIT = r"(?:n[uú]mero de cr[eé]dito|cr[eé]dito(?: n[uú]mero| numero)?|obligaci[oó]n)\s*(?:es el|es|el|#|:)?\s*(\d{3,})"
DOCUMENT = r"(?:documento(?: de identidad)?|c[eé]dula|\bcc\b)\s*(?:es el|es|el|#|:)?\s*(\d(?:[\d\.]{4,}\d)?)"
AMOUNT = r"\$\s?\d{1,3}(?:\.\d{3})+(?:,\d+)?|\$\s?\d{4,}|\b\d{1,3}(?:\.\d{3}){1,3}\b|\b\d{5,7}\b(?!\s*(?:de|del)\b)"
REFERENCE = r"(?:referencia|ref\.?|n[uú]mero de transacci[oó]n|transacci[oó]n|comprobante)\s*(?:n[uú]mero|#|:)?\s*([A-Za-z]?\d{4,})"
MASKED = r"\b\d[\d\.]*[xX]{2,}[\dxX\.]*\b"
METHOD = r"\b(?:PSE|Nequi|Daviplata|Efecty|Baloto|Bancolombia|Davivienda|corresponsal(?:es)? bancarios?|transferencia|tarjeta de cr[eé]dito|tarjeta d[eé]bito|tarjeta|efectivo|banco)\b"
AGENT = r"\b(?:la asesora|el asesor|asesora|asesor)\s+([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+|[a-záéíóúñ]{3,})\b"
NOT_AGENTS = (
    "humano", "real", "que", "me", "de", "para", "por", "fue", "es", "muy",
)
CARD = r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b"
_MONTHS = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
_DAYS = "lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bado|domingo"
_PAY = r"(?:pagu[eé]|pago|pagar|pague|consign[eé]|transfer[ií]|abon[eé]|(?:se )?vence)"
_NEAR = r"(ayer|anteayer|hoy|ma[nñ]ana)"
#: Tried in this order.
PAYMENT_DATES = (
    rf"\b(\d{{1,2}} de (?:{_MONTHS}))\b",
    rf"\b(el (?:{_DAYS})(?: pasado)?)\b",
    rf"\b{_PAY}\b(?:\W+\w+){{0,4}}?\W+{_NEAR}\b",
    rf"\b{_NEAR}\b(?:\W+\w+){{0,3}}?\W+{_PAY}\b",
    r"\b(hace \d+ (?:d[ií]as|semanas?|mes(?:es)?))\b",
    r"\bpagu[eé] (el \d{1,2})\b",
)

#: First matching topic of a message.
TOPICS = (
    ("fraude_seguridad", r"fraude|robaron|hackear|suplantaci|phishing|estafa|clonaron|no reconozco|perd[ií] mi celular|movimientos raros"),
    ("hablar_con_humano", r"asesor humano|persona real|agente real|con un agente|humano|alguien ah[ií]|con alguien|robot"),
    ("queja_reclamo", r"queja|reclamo|p[eé]simo|pqr|supervisor|acoso|superintendencia"),
    ("reporte_centrales", r"datacr[eé]dito|cifin|centrales|report"),
    ("pago_no_aplicado", r"no (se )?(refleja|aplic)|aparece pendiente|dos veces|doble|no me lo han abonado|no aparece"),
    ("no_puede_pagar", r"no (voy a )?pod(er|r[eé]) pagar|no me alcanza|sin trabajo|sin empleo|hospital|enferm|pr[oó]rroga|la mitad"),
    ("refinanciacion_acuerdo", r"refinanci|acuerdo|reestructur|plan de pagos"),
    ("pago_anticipado", r"adelantar|pagar (la totalidad|todo el cr[eé]dito|todo de una)|pago anticipado|saldar|abono a capital"),
    ("intereses_y_cargos", r"tasa de inter[eé]s|cuota de manejo|cobro (adicional|extra)|seguro q|subi[oó] un mont[oó]n|abusivo"),
    ("mora_intereses", r"mora|inter[eé]s"),
    ("fecha_de_pago", r"fecha|vence|cu[aá]ndo (me toca|se vence|es el pago)|d[ií]a me toca"),
    ("metodos_de_pago", r"m[eé]todos? de pago|d[oó]nde (puedo )?pag|c[oó]mo (hago para )?pag|efecty|nequi|baloto|corresponsal|medios de pago|transferencia|link de pago|tarjeta de cr[eé]dito de otro"),
    ("cuenta_y_app", r"\bapp\b|c[oó]digo|otp|bloquead|iniciar sesi[oó]n|contrase[nñ]a|sesi[oó]n|clave"),
    ("datos_personales", r"actualizar|cambi(ar|e) (mi |el )?(n[uú]mero|correo|celular|direcci)|direcci[oó]n|datos personales|datos de contacto"),
    ("certificados_extractos", r"certificad|extracto|paz y salvo|retenci[oó]n|tributario"),
    ("cancelacion", r"cancelar|cerrar (mi )?(cuenta|cr[eé]dito)|cancelaci[oó]n"),
    ("consulta_saldo_cuotas", r"saldo|cu[aá]nto debo|cu[aá]ntas cuotas|cuotas me faltan|valor de la (pr[oó]xima )?cuota|llevo pagad"),
    ("felicitacion_feedback", r"felicit|agradec|gracias|excelente|super amable|muy buena"),
    ("informacion_general", r"horario|abiertos|festivos|n[uú]mero de la l[ií]nea|l[ií]nea de atenci[oó]n|sucursal"),
    ("fuera_de_alcance", r"celular(es)?\b|iphone|rappi|pizzer|clima|francia|\bclaro\b|domicilio|parqueadero|seguros? de veh|hipotecari|carros"),
)

#: Signals of the message profile; a message can show several.
SIGNALS = {
    "credit number mentioned": r"cr[eé]dito (n[uú]mero |numero )?\d{3,}|credito \d{3,}|n[uú]mero de cr[eé]dito \d+",
    "document number mentioned": r"documento (es )?(el )?\d{6,}|documento \d|cc \d|\b\d{10}\b",
    "masked identifier (xx / XXX)": r"\d\.?[0-9x]*x{2,}|X{3}",
    "amount mentioned": r"\$\s?\d|\b\d{1,3}\.\d{3}\b|\b\d{5,7}\b(?! ?\d)|\d+ ?mil\b",
    "transaction / reference mentioned": r"\bref(erencia)?\.? ?\w*\d|transacci[oó]n \w+",
    "explicit date mentioned": r"\b\d{1,2} de \w+|\bel (lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bado|domingo)\b|\bayer\b|\bhace \d+ d[ií]as",
    "bank / payment rail named": r"bancolombia|nequi|daviplata|efecty|baloto|pse\b|corresponsal|transferencia",
    "multi-intent markers": r"\by de paso\b|adem[aá]s|tambi[eé]n|\bdos cosas|\btres cosas|\b1\)|\bvarias cosas|aprovecho",
    "urgency words": r"urgente|ya mismo|!!|inmediat",
    "fraud / security signals": r"fraude|robaron|hackear|suplantaci|phishing|estafa|clonaron|no reconozco|perd[ií] mi celular|movimientos raros",
    "legal / regulatory threat or harassment": r"superintendencia|acoso|habeas|borren mis datos|qu[eé] datos m[ií]os",
    "hardship / vulnerability": r"sin trabajo|sin empleo|hospital|enferm|no puedo pagar|no me alcanza|situaci[oó]n (econ[oó]mica )?(dif[ií]cil|complicada)|pr[oó]rroga",
    "asks for a human": r"asesor humano|persona real|agente|humano|alguien ah[ií]|con alguien",
    "out of scope / other business": r"celular(es)?\b|iphone|rappi|pizzer|clima|francia|\bclaro\b|domicilio|parqueadero|seguros? de veh|hipotecari|carros|cuentas de ahorro",
    "credit-bureau terms": r"datacr[eé]dito|cifin|centrales|report",
    "certificates / statements": r"certificad|extracto|paz y salvo|retenci[oó]n|tributario",
    "password mentioned (KB: login is document + OTP)": r"contrase[nñ]a|clave",
    "address change (not in KB)": r"direcci[oó]n",
    "application status (not in taxonomy)": r"solicitud de cr[eé]dito|estado de mi solicitud",
    "interest / fee dispute (not in taxonomy)": r"tasa de inter[eé]s|cuota de manejo|intereses (excesivos|muy altos|abusiv)|cobro (adicional|extra)|seguro q",
    "prepayment / early settlement (not in taxonomy)": r"adelantar|pagar (la totalidad|todo el cr[eé]dito|todo de una)|pago anticipado|saldar|abono a capital",
    "greeting / thanks only or gibberish": r"^(hola|buenas|ok gracias|todo bien gracias.*|gracias.*|\?+|\.\.\.|asd\w*.*|ggg .*|aksjd.*|hola\?\?.*)$",
    "mojibake (encoding)": r"Ã",
}

#: Reason, policy coverage, action, queue, priority, source of a reply.
REASONS = (
    ("consulta_saldo_cuotas", "partial", "auto_reply", "none", 3, "llm"),
    ("fecha_de_pago", "partial", "auto_reply", "none", 3, "llm"),
    ("no_puede_pagar", "full", "auto_reply_and_route", "cartera", 2, "llm"),
    ("refinanciacion_acuerdo", "full", "auto_reply_and_route", "cartera", 2, "llm"),
    ("pago_no_aplicado", "full", "auto_reply_and_route", "pagos_conciliacion", 2, "llm"),
    ("metodos_de_pago", "full", "auto_reply", "none", 3, "llm"),
    ("mora_intereses", "full", "auto_reply", "none", 3, "llm"),
    ("reporte_centrales", "full", "auto_reply_and_route", "cartera", 2, "llm"),
    ("cuenta_y_app", "partial", "auto_reply", "soporte_tecnico", 2, "llm"),
    ("datos_personales", "partial", "auto_reply", "none", 3, "llm"),
    ("certificados_extractos", "full", "auto_reply", "none", 3, "llm"),
    ("fraude_seguridad", "full", "auto_reply_and_route", "fraude", 0, "llm"),
    ("queja_reclamo", "full", "auto_reply_and_route", "pqr_legal", 2, "llm"),
    ("felicitacion_feedback", "full", "auto_reply", "none", 4, "template"),
    ("cancelacion", "full", "auto_reply_and_route", "cx_general", 3, "llm"),
    ("hablar_con_humano", "none", "route_to_human", "cx_general", 2, "none"),
    ("fuera_de_alcance", "none", "auto_reply", "none", 4, "template"),
    ("intereses_y_cargos", "none", "route_to_human", "pagos_conciliacion", 2, "none"),
    ("pago_anticipado", "full", "auto_reply", "none", 3, "llm"),
    ("estado_solicitud", "none", "route_to_human", "onboarding", 3, "none"),
    ("informacion_general", "none", "route_to_human", "cx_general", 3, "none"),
    ("privacidad_habeas_data", "none", "route_to_human", "datos_privacidad", 2, "none"),
    ("saludo_incompleto", "full", "auto_reply", "none", 4, "template"),
    ("sin_accion", "full", "close_no_reply", "none", 4, "none"),
    ("ruido", "full", "close_no_reply", "none", 4, "none"),
)

#: Hours of service by priority 0 to 4, none for the last.
SLA_HOURS = (1, 4, 24, 48, None)

#: Known holes of the policy, by reason.
GAPS = (
    ("metodos_de_pago", r"\bnequi\b|\bdaviplata\b|\bbaloto\b|link de pago|cuenta bancaria|n[uú]mero de cuenta", "Payment rails other than PSE, cards, Efecty and bank correspondents (Nequi, Daviplata, Baloto, transfers, payment links) are not in the policy."),
    ("cuenta_y_app", r"contrase[nñ]a|password|clave de (?:la |mi )?app|recuperar(?:la)? (?:la )?(?:clave|contrase[nñ]a)", "The policy has no password flow (login is document + OTP); a support case is opened."),
    ("datos_personales", r"direcci[oó]n|ciudad de residencia|\bbarrio\b", "Address changes are not covered by the policy (only phone and e-mail)."),
    ("certificados_extractos", r"retenci[oó]n|certificado de deuda|desglose|saldo a la fecha|capital e intereses", "Only paz y salvo / al día, the payment statement and the interest certificate exist in the policy; other certificates need an agent."),
)

#: Phrases that a reply must not hold.
FORBIDDEN = (
    "condonaci", "te devolvemos", "le devolvemos", "reembolso confirmado", "borramos el historial", "eliminamos el reporte", "quitamos el reporte", "no te reportaremos",
    "no lo reportaremos", "envianos tu contrase", "compartenos tu contrase", "envianos tu clave", "dinos tu codigo", "envianos el codigo", "numero de tu tarjeta",
)

#: Words that tell Spanish, and words that tell English.
SPANISH = (
    "de", "la", "el", "que", "en", "tu", "te", "para", "por", "con", "los", "las", "un", "una", "puedes", "nos", "si", "del", "al", "es", "se", "no", "lo", "tus", "mas", "desde", "hasta",
)
ENGLISH = r"\b(the|please|your|you|we|thanks|hello|and|with)\b"

#: What is left of a template: brackets, and words in capitals.
PLACEHOLDER = r"[\[\]{}<>]|\bX{3,}\b|\bNOMBRE\b|\bTODO\b|\bFIXME\b|\bTBD\b"

#: Numbers, and ordinals, in words, which count as numbers before a unit ("first" is idiom and left out).
NUMBER_WORDS = {
    "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "diez": "10", "quince": "15", "veinte": "20", "treinta": "30", "sesenta": "60",
}
ORDINALS = {
    "segunda": "2", "segundo": "2", "tercera": "3", "tercer": "3", "cuarta": "4", "cuarto": "4", "quinta": "5", "quinto": "5",
}
UNIT = r"(?:d[ií]as?|horas?|minutos?|semanas?|mes(?:es)?|veces|vez|intentos?|a[nñ]os?|cuotas?|pagos?)"
WORD_NUMBER = rf"\b({'|'.join([*NUMBER_WORDS, *ORDINALS])})\s+{UNIT}\b"

#: Sections of the policy that a reply to a reason may cite, in this order; other reasons have none.
SECTIONS = {
    "consulta_saldo_cuotas": ("pagos_y_cuotas.saldo_y_cuotas",),
    "fecha_de_pago": ("pagos_y_cuotas.fechas_de_pago",),
    "no_puede_pagar": ("mora_y_centrales.no_puede_pagar", "mora_y_centrales.mora_e_intereses"),
    "refinanciacion_acuerdo": ("mora_y_centrales.no_puede_pagar",),
    "pago_no_aplicado": ("pagos_y_cuotas.pagos_no_aplicados",),
    "metodos_de_pago": ("pagos_y_cuotas.metodos_de_pago",),
    "mora_intereses": ("mora_y_centrales.mora_e_intereses", "mora_y_centrales.reporte_centrales"),
    "reporte_centrales": ("mora_y_centrales.reporte_centrales", "mora_y_centrales.paz_y_salvo"),
    "cuenta_y_app": ("cuenta_app_seguridad.acceso_otp", "cuenta_app_seguridad.cuenta_bloqueada", "cuenta_app_seguridad.app_no_funciona"),
    "datos_personales": ("datos_certificados_pqr.actualizacion_datos",),
    "certificados_extractos": ("datos_certificados_pqr.certificados_extractos", "mora_y_centrales.paz_y_salvo"),
    "fraude_seguridad": ("cuenta_app_seguridad.fraude_seguridad",),
    "queja_reclamo": ("datos_certificados_pqr.pqr",),
    "cancelacion": ("datos_certificados_pqr.cancelacion", "pagos_y_cuotas.pago_anticipado"),
    "pago_anticipado": ("pagos_y_cuotas.pago_anticipado",),
}

#: Sections that an override adds.
EXTRA_SECTIONS = {"OVR_LEGAL": ("datos_certificados_pqr.pqr",)}
