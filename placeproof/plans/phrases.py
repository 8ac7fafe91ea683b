"""Text rules against phrases whose reading is written down here by hand; nothing is shared with the rules' own words.

Each document's title is one of the phrases, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from placeproof.functions import rules
from placeproof.plans.registry import query
from placeproof.plans.views import case, table

# Fixed values: (title, no photo of a place, people or event, specimen).
PHRASES = [
    ("Protestors on the square", 0, 1, 0), ("A protest anthem", 0, 1, 0), ("Protestant chapel", 0, 0, 0), ("She delivered a lecture", 0, 1, 0),
    ("He delivers their speeches", 0, 1, 0), ("Speech hall", 0, 0, 0), ("Speech day", 0, 1, 0), ("На демонстрацию", 0, 1, 0),
    ("Демонстрационный корпус", 0, 0, 0), ("Police garden", 0, 1, 0), ("Police precinct", 0, 0, 0), ("Policemen in the yard", 0, 1, 0),
    ("Conference museum", 0, 1, 0), ("Conference centre", 0, 0, 0), ("Meeting point", 0, 0, 0), ("Meeting of the board", 0, 1, 0),
    ("Rally point", 0, 0, 0), ("Rallies of spring", 0, 1, 0), ("Demonstration reactor", 0, 0, 0), ("Demonstrators", 0, 1, 0),
    ("March 2020", 0, 0, 0), ("Marching for peace", 0, 1, 0), ("Strikers", 0, 1, 0), ("Striking arch", 0, 0, 0), ("Sitins and sit-ins", 0, 1, 0),
    ("Shaking hands", 0, 1, 0), ("Posing twins", 0, 1, 0), ("Position lights", 0, 0, 0), ("Visit to the pier", 0, 1, 0), ("Visits", 0, 0, 0),
    ("Visita oficial", 0, 1, 0), ("Visita guiada", 0, 0, 0), ("Rede von gestern", 0, 1, 0), ("Министры", 0, 1, 0), ("Министерство", 0, 0, 0),
    ("경찰 버스", 0, 1, 0), ("경찰서", 0, 0, 0), ("총장실", 0, 1, 0), ("Under a powerful microscope", 1, 0, 1), ("Under microscope 4", 1, 0, 1),
    ("Microscopy suite", 0, 0, 0), ("Microscopes", 0, 0, 1), ("AFM scan", 1, 0, 0), ("Electron microscopy images", 1, 0, 1), ("Почтовую марку", 1, 0, 0),
    ("Почтовые марки", 1, 0, 0), ("QS 2019", 1, 0, 0), ("QS worlds", 1, 0, 0), ("Quiet seat", 0, 0, 0), ("Recovery", 0, 0, 0), ("Covers", 1, 0, 0),
    ("Scanner room", 0, 0, 0), ("Scanned page", 1, 0, 0), ("Bacteria", 0, 0, 1), ("Bacterial", 0, 0, 1), ("Synthesizing", 0, 0, 1),
    ("Photosynthesis", 0, 0, 0), ("Samples", 0, 0, 1), ("Sample street", 0, 0, 0), ("Stone stairs", 0, 0, 0),
]
TITLE = case(f"doc_id % {len(PHRASES)}", [p[0] for p in PHRASES])
FLAGS = ", ".join(f"{case(f'doc_id % {len(PHRASES)}', [p[i] for p in PHRASES])} = 1 AS {name}" for i, name in ((1, "no_photo"), (2, "people"), (3, "specimen")))


@query("rule_phrases", f"SELECT doc_id, {TITLE} AS title, {FLAGS} FROM documents")
def rule_phrases(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{TITLE} AS title").withColumn("low", F.lower("title"))
    return rows.select("doc_id", "title", rules.matches("low", rules.NOT_A_PHOTO).alias("no_photo"), rules.matches("low", rules.PEOPLE_OR_EVENT).alias("people"),
                       rules.matches("low", rules.SPECIMEN).alias("specimen"))
