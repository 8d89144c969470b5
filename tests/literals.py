"""Our own small inputs."""

NORMS = [
    {"norm_id": "N-1", "short_name": "LPX", "title": "Ley de Pruebas", "aliases": ["Ley 7/1999", "Ley de Pruebas"], "rank": "ley", "jurisdiction": "ES", "legal_effect": "binding", "topics": ["pruebas"]},
    {"norm_id": "N-2", "short_name": "RDX", "title": "Reglamento de Ensayos", "aliases": ["Real Decreto 8/2001", "Ley"], "rank": "real_decreto", "jurisdiction": "ES", "legal_effect": "binding", "topics": ["ensayos"]},
]



def paragraph(text, css="parrafo"):
    return f'<p class="{css}">{text}</p>'


def version(since, *content):
    return f'<version fecha_publicacion="{since}">{"".join(content)}</version>'


def block(name, kind, title, *versions, until=None):
    expiry = f' fecha_caducidad="{until}"' if until else ""
    return f'<bloque id="{name}" tipo="{kind}" titulo="{title}"{expiry}>{"".join(versions)}</bloque>'


def article(i, *lines, since="20000101", until=None, title=""):
    """Article ``i`` with a rubric made from its number."""
    label = title or f"Artículo {i}"
    return block(f"a{i}", "precepto", label, version(since, paragraph(f"{label}. Materia {i}.", "articulo"), *map(paragraph, lines)), until=until)


def document(*blocks):
    return "<response><status><code>200</code></status><data><texto>" + "".join(blocks) + "</texto></data></response>"


def grid(rows, columns, heads=True, start=0):
    """A table whose cell in row r and column c is r * c with one decimal."""
    head = "<tr>" + "".join(f"<th>col{c}</th>" for c in range(columns)) + "</tr>" if heads else ""
    return "<table>" + head + "".join("<tr>" + "".join(f"<td>{r * c},{c % 10}</td>" for c in range(columns)) + "</tr>" for r in range(start, start + rows)) + "</table>"


#: One article over time: an old wording, one in force since March 2021 with a note and a footnote, and one to come.
_OVER_TIME = block(
    "a1", "precepto", "Artículo 1",
    *[version(since, paragraph("Artículo 1. Materia 1.", "articulo"), paragraph(text), *more) for since, text, more in (
        ("20291231", "Texto por llegar.", ()), ("20000102", "Texto de antes.", ()),
        ("20210301", "Texto actual.", ('<blockquote class="nota"><p>Véase el anejo.</p></blockquote>', paragraph("Redacción de 2021.", "nota_pie"))),
    )],
)
OVER_TIME = document(_OVER_TIME)

#: What the engine indexes: a disposition about a time limit, then four articles under one heading.
XML = document(
    block("plazos", "precepto", "Disposición adicional tercera", version("20000101", paragraph("Disposición adicional tercera. Plazos.", "articulo"), paragraph("Diez días."))),
    block("cap", "encabezado", "CAPÍTULO IV", version("20000101", paragraph("CAPÍTULO IV", "capitulo_num"), paragraph("De las pruebas", "capitulo_tit"))),
    _OVER_TIME, *[article(i, f"Regla número {i}.") for i in (2, 3, 4)],
)

#: Headings of three levels, one of them typed as a provision; a disposition ends them all.
HEADINGS = document(
    block("lib", "encabezado", "LIBRO II", version("20000101", paragraph("LIBRO II", "libro_num"), paragraph("De los ensayos.", "libro_tit"))),
    article(7, "Fuera de capítulo."),
    block("cap", "encabezado", "CAPÍTULO V", version("20000101", paragraph("CAPÍTULO V", "capitulo_num"), paragraph("Muestras", "capitulo_tit"))),
    block("sec", "precepto", "Sección 2.ª", version("20000101", paragraph("Sección 2.ª Envases", "seccion"))),
    article(8, "Previo.", "1. Limpios:", "1.º por dentro.", "2. Secos.", title="Artículo octavo ter"),
    block("dt", "precepto", "Disposición transitoria undécima", version("20000101", paragraph("Disposición transitoria undécima. Ritmo.", "articulo"), paragraph("Despacio."))),
)

#: What is left out or marked: repealed in its label, expired in 2010, a final provision that amends another law.
MARKED = document(
    block("df", "precepto", "Disposición final segunda", version("20000101", paragraph("Disposición final segunda. Modificación del Real Decreto 5/1988.", "articulo"), paragraph("Se cambia."))),
    article(5, "Hasta 2010.", until="20100101"),
    block("a6", "precepto", "Artículo 6", version("20000101", paragraph("Artículo 6. (Derogado).", "articulo"))),
)

#: The instrument that approves a text comes before the text.
APPROVED = document(article(1, "Se aprueba lo que sigue."), block("ini", "encabezado", "TEXTO", version("20000101", paragraph("TEXTO", "titulo"))), article(2, "Lo que sigue."))

#: A table of words, a numeric one of 9 rows in two parts, and one of 12 rows under another caption.
TABLES = document(
    block(
        "an", "precepto", "ANEXO",
        version(
            "20000101", paragraph("ANEXO", "anexo_num"), paragraph("Medidas", "anexo_tit"),
            "<table><tr><th>Clase</th><th>Uso</th></tr><tr><td>vidrio|barro</td><td>agua</td></tr></table>",
            paragraph("Tabla 3.C", "centro_redonda"), grid(8, 3), paragraph("Tabla 3.C (continuación)", "centro_redonda"), grid(1, 3, False, 8),
            paragraph("Tabla 3.D", "centro_redonda"), grid(12, 4),
        ),
    )
)
