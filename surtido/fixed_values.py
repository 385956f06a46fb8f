"""Values that are part of the data contract and therefore fixed."""

# --- Fixed values: column names of an incoming sales file and the stored names.
REQUIRED_COLUMNS = ("SKU", "Fecha Venta", "Cantidad")
STORED_NAMES = {
    "SKU": "id_producto",
    "Fecha Venta": "fecha",
    "Cantidad": "cantidad_vendida",
}
SHEET_NAME = "Detalle"

# --- Fixed values: states.
FILE_STATES = ("valido", "aprobado", "procesado", "invalido")
ALERT_STATES = ("PENDIENTE", "EN GESTIÓN", "DESCARTADA")
ACTIVE_ALERT_STATES = ("PENDIENTE", "EN GESTIÓN")
QUIEBRE = "QUIEBRE"
SOBRESTOCK = "SOBRESTOCK"

# --- Fixed values: message formats.
MSG_QUIEBRE = "Riesgo de quiebre. Stock: %d. Demanda esperada: %d. Proyectado: %d. Umbral: %d."
MSG_SOBRESTOCK = (
    "Sobrestock detectado. Stock: %d. Demanda esperada: %d. Proyectado: %d. Umbral máximo: %d."
)

# --- Fixed values: alert defaults.
DEFAULT_AVERAGE = 10.0
SAFETY_STOCK_FACTOR = 0.5
OVERSTOCK_FACTOR = 30
HORIZON_DAYS = 2

# --- Fixed values: feature columns, in training order.
FEATURES = ("id_producto_encoded", "mes", "anio", "dia_semana", "dia")
TARGET = "cantidad_vendida"

# --- Fixed values: hyperparameters.
TEST_SHARE = (1, 5)
TREES = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "seed": 42}
NETWORK_LAYERS = (5, 64, 32, 1)
NETWORK_LEARNING_RATE = 0.001
NETWORK_EPOCHS = 100
NETWORK_PATIENCE = 10
NETWORK_VALIDATION_SHARE = (1, 5)

# --- Fixed values: texts read as a missing SKU in a sales file (the markers
# pandas documents as its default missing values).
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- Accepted dates, tried in this order; a time of day may follow each of them.
# Where day and month could be either, the month comes first; a day above 12
# says for itself. ``DAY_FIRST_FORMATS`` is the choice for day-first sources.
DATE_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd",
    "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "M.d.yyyy", "d.M.yyyy",
)
DAY_FIRST_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd",
    "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "d.M.yyyy", "M.d.yyyy",
)

# --- Our own texts, free to change.
MSG_NO_VALID_ROWS = "Ninguna fila sirve: revise fechas, cantidades y SKU."
MSG_EMPTY_FILE = "Sin filas de datos."
MSG_NO_SHEET = "Falta la hoja Detalle en el libro."
MSG_BAD_FORMAT = "Tipo de archivo desconocido: se leen csv y xlsx."
MSG_MISSING_COLUMNS = "Faltan columnas: "
MSG_UNREADABLE = "No se pudo leer: "
MSG_LONG_HEADER = "La línea de títulos no termina en los primeros %d bytes."
MSG_SAVED = "Ventas guardadas."
MSG_UNDECIDED = " Sin decidir si el día o el mes va primero en %d fechas."
MODEL_TREES = "Árboles potenciados"
MODEL_NETWORK = "Red densa"
MODEL_HYBRID = "Media de árboles y red"
