"""Declared schemas of the stored tables."""

POINT = "struct<x:double,y:double,err_x:double,err_y:double>"
ANNOTATION = "struct<marker:string,x:double,p_value:double>"
PAPERS = "id long, doi string, title string, authors array<string>, journal string, year int, pdf_path string, processed_at timestamp"
FIGURES = (
    "id long, paper_id long, figure_number string, panel_label string, page_number int, figure_type string, caption string, image_path string, "
    "bounding_box struct<x:double,y:double,w:double,h:double>, confidence_score double, processed_at timestamp, source_key string"
)
SERIES = (
    f"id long, figure_id long, series_name string, x_label string, x_unit string, y_label string, y_unit string, data_points array<{POINT}>, axis_scale_x string, axis_scale_y string, "
    f"statistical_annotations array<{ANNOTATION}>, extraction_method string, confidence_score double"
)
ERRORS = "id long, figure_id long, error_type string, error_message string, timestamp timestamp"
TABLES = {"papers": PAPERS, "figures": FIGURES, "series": SERIES, "errors": ERRORS}
