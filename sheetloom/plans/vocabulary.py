"""The control graph: fixed vocabulary values, as DataFrames and as nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Concepts (name, description, category).
CONCEPTS = [
    ("Datasheet", "A technical datasheet document used as input for extraction.", "instance_label"),
    ("Equipment", "A product or device described by a datasheet.", "instance_label"),
    ("TechnicalParameter", "An extracted technical parameter value from a datasheet.", "instance_label"),
    ("ParameterType", "A normalized vocabulary concept describing the semantic type of a technical parameter.", "vocabulary_label"),
    ("Unit", "A normalized unit vocabulary concept.", "vocabulary_label"),
    ("Evidence", "Source evidence supporting an extracted technical parameter.", "instance_label"),
    ("ExtractionRun", "A record of one extraction run.", "instance_label"),
    ("ValidationIssue", "A validation issue detected after extraction or graph population.", "instance_label"),
]
# Relationship definitions (name, description, from concept, to concept).
RELATIONSHIPS = [
    ("DESCRIBES", "Links a datasheet to the equipment described by it.", "Datasheet", "Equipment"),
    ("HAS_PARAMETER", "Links equipment to an extracted technical parameter.", "Equipment", "TechnicalParameter"),
    ("HAS_PARAMETER_TYPE", "Links an extracted technical parameter to its normalized parameter type.", "TechnicalParameter", "ParameterType"),
    ("HAS_UNIT", "Links an extracted technical parameter to its normalized unit.", "TechnicalParameter", "Unit"),
    ("EVIDENCED_BY", "Links an extracted technical parameter to its supporting source evidence.", "TechnicalParameter", "Evidence"),
    ("GENERATED_BY", "Links an extracted technical parameter to the extraction run that generated it.", "TechnicalParameter", "ExtractionRun"),
    ("ABOUT", "Links a validation issue to the graph element it concerns.", "ValidationIssue", "TechnicalParameter"),
    ("HAS_EQUIPMENT_TYPE", "Links extracted equipment to its normalized equipment type.", "Equipment", "Equipment"),
]
# Parameter types (name, display name, description, value type, priority, category, expects a unit, weight, hint, aliases, keywords).
PARAMETER_TYPES = [
    ("Manufacturer", "Manufacturer", "The manufacturer of the device.", "string", "optional", "identification", False, 1,
     "Extract the company or manufacturer name of the device.",
     ["manufacturer", "company", "vendor", "supplier", "Vishay", "Vishay Semiconductors"], ["manufacturer", "Vishay", "Vishay Semiconductors"]),
    ("ProductModel", "Product model", "The product model or part number.", "string", "required", "identification", False, 4,
     "Extract the exact product model or part number described by the datasheet.",
     ["product model", "model", "part number", "part no.", "device", "type", "TEMT6000X01"], ["TEMT6000X01", "ambient light sensor", "datasheet"]),
    ("DeviceType", "Device type", "The general device type described by the datasheet.", "string", "required", "identification", False, 3,
     "Extract the general type of device described by the datasheet.",
     ["device type", "product type", "sensor type", "ambient light sensor", "light sensor", "photo sensor", "photosensor"], ["ambient light sensor", "light sensor", "photosensor"]),
    ("PackageType", "Package type", "The package or mounting type of the device.", "string", "optional", "packaging", False, 2,
     "Extract the general package or mounting type, such as surface-mount package.",
     ["package type", "mounting type", "surface mount", "surface-mount", "SMD", "SMT"], ["package", "surface mount", "surface-mount", "SMD"]),
    ("PackageForm", "Package form", "The specific package form or package code, such as 1206.", "string", "required", "packaging", False, 3,
     "Extract the specific package form or package code, such as 1206.",
     ["package form", "package code", "package size", "case size", "1206"], ["1206", "package", "package size", "case size"]),
    ("Dimensions", "Dimensions", "Physical dimensions of the device.", "string_or_dimension_tuple", "required", "physical_dimension", True, 4,
     "Extract the physical dimensions of the device. Preserve the dimensional expression and unit, for example 4 x 2 x 1.05 mm.",
     ["dimensions", "dimension", "size", "length", "width", "height", "L x W x H"], ["dimensions", "dimension", "size", "length", "width", "height", "mm"]),
    ("PeakSensitivityWavelength", "Peak sensitivity wavelength", "The wavelength at which the sensor has peak sensitivity.", "number", "required", "optical", True, 5,
     "Extract the wavelength at which the sensor has peak sensitivity. The value is typically expressed in nm.",
     ["peak sensitivity", "peak wavelength", "wavelength of peak sensitivity", "spectral sensitivity", "lambda p", "λp", "sensitivity wavelength"],
     ["peak sensitivity", "peak wavelength", "spectral sensitivity", "wavelength", "λp", "nm"]),
    ("AngleOfHalfSensitivity", "Angle of half sensitivity", "The angle at which sensor sensitivity drops to half of its maximum.", "number_or_range", "optional", "optical", True, 3,
     "Extract the angle of half sensitivity. The value may be expressed as an angular range such as ±60 degree.",
     ["angle of half sensitivity", "half sensitivity angle", "viewing angle", "angle", "±60", "+/-60"], ["angle of half sensitivity", "half sensitivity", "viewing angle", "angle", "degree"]),
]
# Required parameters (id, reason, parameter type).
REQUIRED = [
    ("required_product_model", "The product model identifies the device described by the datasheet.", "ProductModel"),
    ("required_device_type", "The device type is required for classifying the extracted equipment.", "DeviceType"),
    ("required_package_form", "The package form is a core device specification for the MVP datasheet.", "PackageForm"),
    ("required_dimensions", "Physical dimensions are a core technical parameter for the MVP datasheet.", "Dimensions"),
    ("required_peak_sensitivity_wavelength", "Peak sensitivity wavelength is a characteristic optical parameter of the ambient light sensor.", "PeakSensitivityWavelength"),
]
# Equipment types (name, display name, description, scope, source product, aliases).
EQUIPMENT_TYPES = [
    ("AmbientLightSensor", "Ambient light sensor", "A sensor device that detects ambient light intensity.", "mvp", "Vishay TEMT6000X01",
     ["ambient light sensor", "ambient light sensors", "light sensor", "photo sensor", "photosensor"]),
    ("DigitalAccelerometer", "Digital accelerometer", "A sensor device that measures acceleration and provides digital output.", "variation", "Analog Devices ADXL345",
     ["accelerometer", "digital accelerometer", "3-axis accelerometer", "three-axis accelerometer", "3-axis digital accelerometer"]),
]
# Units (symbol, name, dimension, scope, description).
UNITS = [
    ("mm", "millimetre", "length", "mvp", "Millimetre, used for physical dimensions."),
    ("nm", "nanometre", "length", "mvp", "Nanometre, used for optical wavelength."),
    ("degree", "degree", "angle", "mvp", "Degree, used for angular values such as half-sensitivity angle."),
    ("g", "standard gravity", "acceleration", "variation", "Unit used for acceleration measurement range."),
    ("bit", "bit", "digital_resolution", "variation", "Unit used for digital resolution."),
    ("V", "volt", "voltage", "variation", "Volt, used for supply voltage."),
    ("µA", "microampere", "electric_current", "variation", "Microampere, used for current consumption."),
    ("°C", "degree Celsius", "temperature", "variation", "Degree Celsius, used for operating temperature range."),
]
# Allowed units (parameter type, unit).
ALLOWED = [("Dimensions", "mm"), ("PeakSensitivityWavelength", "nm"), ("AngleOfHalfSensitivity", "degree")]

SCHEMAS = {
    "concept": (CONCEPTS, "name string, description string, category string"),
    "relationship_definition": (RELATIONSHIPS, "name string, description string, from_concept string, to_concept string"),
    "parameter_type": (PARAMETER_TYPES, "name string, display_name string, description string, value_type string, priority string, parameter_category string, expects_unit boolean, screening_weight int, extraction_hint string, aliases array<string>, screening_keywords array<string>"),
    "required_parameter": (REQUIRED, "id string, reason string, parameter_type string"),
    "equipment_type": (EQUIPMENT_TYPES, "name string, display_name string, description string, scope string, source_product string, aliases array<string>"),
    "unit": (UNITS, "symbol string, name string, dimension string, scope string, description string"),
    "allowed_unit": (ALLOWED, "parameter_type string, unit string"),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = SCHEMAS[name]
    return spark.createDataFrame(rows, schema)


#: Label of each vocabulary table's nodes and the property that identifies them.
LABELS = {"concept": ("Concept", "name"), "relationship_definition": ("RelationshipDefinition", "name"), "parameter_type": ("ParameterType", "name"), "required_parameter": ("RequiredParameter", "id"), "equipment_type": ("EquipmentType", "name"), "unit": ("Unit", "symbol")}


def control_graph() -> tuple[list[tuple[str, str, dict]], list[tuple[str, str, str, str, str]]]:
    """(label, identity, properties) of every control node and (from label, from, type, to label, to) of every control edge."""
    nodes = []
    for name, (label, key) in LABELS.items():
        rows, schema = SCHEMAS[name]
        columns = [c.strip().split(" ")[0] for c in schema.split(", ")]
        drop = {"from_concept", "to_concept"} | ({"parameter_type"} if name == "required_parameter" else set())
        nodes += [(label, dict(zip(columns, r, strict=True))[key], {c: v for c, v in zip(columns, r, strict=True) if c not in drop}) for r in rows]
    edges = [("RelationshipDefinition", r[0], t, "Concept", c) for r in RELATIONSHIPS for t, c in (("FROM_CONCEPT", r[2]), ("TO_CONCEPT", r[3]))]
    edges += [("ParameterType", p[0], "INSTANCE_OF_CONCEPT", "Concept", "ParameterType") for p in PARAMETER_TYPES]
    edges += [("EquipmentType", e[0], "INSTANCE_OF_CONCEPT", "Concept", "Equipment") for e in EQUIPMENT_TYPES]
    edges += [("Unit", u[0], "INSTANCE_OF_CONCEPT", "Concept", "Unit") for u in UNITS]
    edges += [("RequiredParameter", r[0], "REQUIRES_PARAMETER_TYPE", "ParameterType", r[2]) for r in REQUIRED]
    edges += [("ParameterType", p, "ALLOWS_UNIT", "Unit", u) for p, u in ALLOWED]
    return nodes, edges
