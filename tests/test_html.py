from lexframe.functions import html

PAGE = '<style>p{}</style><script>var t="<p>no</p>";</script><!-- <p>no</p> --><h1>T</h1><P class="x">uno <b>dos</b><br>tres<p>cuatro<div>x</div><p></p><pre>no</pre><p>fin'


def test_every_paragraph_with_inline_text(spark):
    rows = spark.createDataFrame([(PAGE,), (None,)], "h string").select(html.paragraphs("h")).collect()
    assert [r[0] for r in rows] == [["uno dos tres", "cuatro", "", "fin"], None]
