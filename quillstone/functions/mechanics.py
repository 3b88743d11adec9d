"""The catalogue of exercise mechanics as reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Id, name, family, requirements (key:least), signals (dimension/form/modality/target).
CATALOGUE = """
A1|RECONOCER|A|concepto:4 distractores:1|recuperacion/escalar/reconocimiento/concepto anclaje/observacional//repertorio automatizacion/temporal//concepto
A2|COMPLETAR|A|concepto:4|recuperacion/escalar/produccion_guiada/concepto
A3|EVOCAR|A|concepto:4 sinonimos:1|recuperacion/escalar/produccion_guiada/concepto automatizacion/temporal//concepto
A4|DEFINIR|A|concepto:4 juez:1|recuperacion/escalar/produccion_libre/concepto relacion/escalar/produccion_libre/arista anclaje/observacional//repertorio
B1|DISTINGUIR|B|distractores:1|recuperacion/escalar/reconocimiento/concepto relacion/escalar/reconocimiento/arista anclaje/observacional//repertorio
B2|CLASIFICAR|B|caso_gold:3|recuperacion/escalar/reconocimiento/concepto transferencia/escalar/reconocimiento/caso anclaje/observacional//repertorio
B3|TAGGEAR|B|caso_gold:3|recuperacion/escalar/produccion_guiada/concepto transferencia/escalar/produccion_guiada/concepto anclaje/observacional//repertorio
C1|CONECTAR|C|arista:5|relacion/escalar/reconocimiento/arista anclaje/observacional//repertorio automatizacion/temporal//arista
C2|ORDENAR|C|arista_tipo:causa:2|relacion/escalar/produccion_guiada/arista relacion/escalar/produccion_guiada/cluster transferencia/escalar/produccion_guiada/cluster
C3|AGRUPAR|C|cluster:1 concepto:6|relacion/escalar/accion_estructural/cluster anclaje/observacional//repertorio
C4|MAPEAR|C|eje:2|relacion/escalar/accion_estructural/cluster relacion/escalar/accion_estructural/arista
C5|CONTRASTAR|C|arista_tipo:contrasta:1 juez:1|relacion/escalar/produccion_libre/arista anclaje/observacional//repertorio
D1|CONSTRUIR|D|arista:8 cluster:1|relacion/escalar/accion_estructural/arista relacion/escalar/accion_estructural/cluster anclaje/observacional//repertorio
D2|EXTENDER|D|arista:8|relacion/escalar/accion_estructural/arista transferencia/escalar/accion_estructural/concepto
D3|CRITICAR|D|arista:8 juez:1|relacion/escalar/produccion_libre/arista transferencia/escalar/produccion_libre/cluster articulacion/escalar/produccion_libre/arista anclaje/observacional//repertorio
E1|PREDECIR|E|caso_gold:2|transferencia/escalar/produccion_guiada/caso anclaje/observacional//repertorio
E2|DIAGNOSTICAR|E|caso_error:1 juez:1|transferencia/escalar/produccion_libre/caso relacion/escalar/produccion_libre/arista articulacion/escalar/produccion_libre/caso anclaje/observacional//repertorio
E3|APLICAR|E|caso_gold:3|transferencia/escalar/produccion_guiada/caso anclaje/observacional//repertorio
E4|GENERAR EJEMPLO|E|concepto:4 juez:1|transferencia/escalar/produccion_libre/concepto articulacion/escalar/produccion_libre/concepto anclaje/observacional//repertorio
E5|RESOLVER|E|caso_multi:1 juez:1|transferencia/escalar/produccion_libre/caso relacion/escalar/produccion_libre/cluster articulacion/escalar/produccion_libre/caso anclaje/observacional//repertorio
F1|EXPLICAR|F|concepto:4 juez:1|recuperacion/escalar/produccion_libre/concepto relacion/escalar/produccion_libre/arista articulacion/escalar/produccion_libre/concepto anclaje/observacional//repertorio
F2|ARGUMENTAR|F|tesis:1 juez:1|relacion/escalar/produccion_libre/argumento articulacion/escalar/produccion_libre/argumento transferencia/escalar/produccion_libre/argumento anclaje/observacional//repertorio
F3|REFUTAR|F|tesis:1 marco_rival:1 juez:1|relacion/escalar/produccion_libre/argumento relacion/escalar/produccion_libre/cluster articulacion/escalar/produccion_libre/argumento anclaje/observacional//repertorio
F4|REFORMULAR|F|concepto:4 juez:1|articulacion/escalar/produccion_libre/concepto recuperacion/escalar/produccion_libre/concepto
F5|TRADUCIR|F|concepto:4 juez:1|transferencia/escalar/produccion_libre/concepto articulacion/escalar/produccion_libre/concepto anclaje/observacional//repertorio
G1|APOSTAR|G|ninguno:1|calibracion/calibracion/declaracion_metacognitiva/concepto
G2|ESTIMAR|G|ninguno:1|calibracion/calibracion/declaracion_metacognitiva/sesion
G3|ANTICIPAR DIFICULTAD|G|ninguno:1|calibracion/calibracion/declaracion_metacognitiva/concepto
G4|EXPLICAR ERROR PROPIO|G|ninguno:1|srl_autorreflexion/escalar/declaracion_metacognitiva/sesion anclaje/observacional//repertorio articulacion/escalar/produccion_libre/concepto
G5|MARCAR DIFICULTAD|G|ninguno:1|srl_autorreflexion/escalar/declaracion_metacognitiva/sesion calibracion/calibracion/declaracion_metacognitiva/concepto
H1|JUSTIFICAR A PEER|H|peer:1 concepto:4|articulacion/escalar/produccion_libre/concepto recuperacion/escalar/produccion_libre/concepto anclaje/observacional//repertorio
H2|NEGOCIAR|H|peer:1 arista:5|articulacion/escalar/produccion_libre/concepto relacion/escalar/produccion_libre/arista srl_accion/observacional//sesion
H3|ENSEÑAR|H|peer:1 concepto:4|articulacion/escalar/produccion_libre/concepto recuperacion/escalar/produccion_libre/concepto
H4|EVALUAR PEER|H|peer:1 tesis:1|srl_autorreflexion/escalar/declaracion_metacognitiva/sesion transferencia/escalar/produccion_guiada/argumento
H5|DEFENDER VS PEER|H|peer:1 tesis:1|relacion/escalar/produccion_libre/argumento articulacion/escalar/produccion_libre/argumento srl_autorreflexion/escalar/declaracion_metacognitiva/sesion persistencia/escalar//global
I1|PLANEAR|I|ninguno:1|srl_planeacion/escalar/declaracion_metacognitiva/sesion
I2|MONITOREAR|I|ninguno:1|srl_accion/observacional//sesion
I3|PEDIR AYUDA|I|ninguno:1|srl_accion/observacional//sesion
I4|REFLEXIONAR|I|ninguno:1|srl_autorreflexion/escalar/declaracion_metacognitiva/sesion articulacion/escalar/produccion_libre/concepto
I5|CONSOLIDAR|I|ninguno:1|srl_autorreflexion/escalar/declaracion_metacognitiva/sesion articulacion/escalar/produccion_libre/cluster recuperacion/escalar/produccion_libre/concepto calibracion/calibracion/declaracion_metacognitiva/concepto
"""
PLAYABLE = ("A1", "A3", "B1", "B2", "C1", "E1", "E3")

ROWS = [line.split("|") for line in CATALOGUE.strip().splitlines()]
MECHANICS = [(m, name, family) for m, name, family, _, _ in ROWS]
REQUIREMENTS = [(m, r.rpartition(":")[0], int(r.rpartition(":")[2])) for m, _, _, needs, _ in ROWS for r in needs.split()]
EMITS = [(m, d, f, mod or None, target) for m, _, _, _, signals in ROWS for d, f, mod, target in (s.split("/") for s in signals.split())]


def mechanics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MECHANICS, "mechanic_id string, name string, family string")


def requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUIREMENTS, "mechanic_id string, key string, least int")


def emits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EMITS, "mechanic_id string, dimension string, forma string, modality string, target string")
