"""Small inputs shared by the tests."""

from pyspark.sql.types import LongType, StructField, StructType

from clauseweave.schema import CHUNK

# A glasshouse manual: its own part token, three machines, two flows.
PART_TOKEN, FILE_TOKEN = "77012", "77012-b4"


def _data(**values):
    return "".join(f'<data key="{key}">{value}</data>' for key, value in values.items())


def plant_graphml():
    """GraphML of the glasshouse: boiler feeds valve, valve feeds tank."""
    declared = [("k_kind", "node", "entity_type"), ("k_file", "node", "source_file"), ("k_at", "node", "file_path")]
    declared += [("k_rel", "edge", "keywords"), ("k_from", "edge", "file_path")]
    keys = "\n".join(f'  <key id="{i}" for="{kind}" attr.name="{name}" attr.type="string"/>' for i, kind, name in declared)
    boiler = _data(k_kind="Machine", k_file=f"manual/{FILE_TOKEN}.docx", k_at=f"manual/{FILE_TOKEN}.md3.2")
    elements = [
        f'<node id="boiler">{boiler}</node>',
        f'<node id="valve">{_data(k_kind="Part")}</node>',
        '<node id="tank"/>',
        f'<edge id="f1" source="boiler" target="valve">{_data(k_rel="Feeds&lt;SEP&gt;Heats", k_from=f"manual/{FILE_TOKEN}.md3.4")}</edge>',
        f'<edge id="f2" source="valve" target="tank">{_data(k_rel="Feeds")}</edge>',
    ]
    body = "\n".join(f"    {e}" for e in elements)
    return f"""<?xml version="1.0" encoding="utf-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
{keys}
  <graph id="plant"
         edgedefault="directed">
{body}
  </graph>
</graphml>
"""


def chunk(chunk_id, section, title, text, seq=0, kind="paragraph"):
    top = section.split(".")[0]
    return dict(
        chunk_id=chunk_id, chunk_seq=seq, section=section, section_title=title, text=text, content_type=kind,
        heading_path=[top, section] if top != section else [top], page_start=seq + 1, page_end=seq + 2,
        spec_id="Glasshouse manual", release="Issue 4", version="4.1", source_file=f"{FILE_TOKEN}.docx",
    )


def frame(spark, rows):
    rows = [{**row, "chunk_seq": i} for i, row in enumerate(rows)]
    schema = StructType([*CHUNK.fields, StructField("chunk_seq", LongType())])
    return spark.createDataFrame(rows, schema)


def graph(spark, nodes, edges):
    """nodes: {id: attributes}; edges: [(id, source, target, attributes)]."""
    from clauseweave.schema import EDGES, NODES

    n = [(node_id, i + 1, attributes) for i, (node_id, attributes) in enumerate(nodes.items())]
    e = [(e[0], e[1], e[2], i + 1, e[3] if len(e) > 3 else {}) for i, e in enumerate(edges)]
    return spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES)
