"""Vocabularies, limits and lookup constants of the data contract."""

# Business time zone, platforms, order statuses and largest accepted values.
BUSINESS_TZ = "Asia/Ho_Chi_Minh"
PLATFORMS = ("shopee", "tiktok")
CANCELLED = ("CANCELLED", "IN_CANCEL", "CANCEL_REQUESTED")
STATUSES = (
    "UNPAID", "READY_TO_SHIP", "SHIPPED", "COMPLETED", "CANCELLED", "IN_CANCEL", "TO_RETURN",
    "AWAITING_SHIPMENT", "AWAITING_COLLECTION", "DELIVERED", "IN_TRANSIT", "CANCEL_REQUESTED",
)
MAX_QUANTITY = 100
MAX_AMOUNT = 1_000_000_000.0

# Warehouse column lengths.
LENGTH_LIMITS = {
    "order_id": 50, "sku": 50, "source_line_id": 128, "product_name": 500, "category": 100,
    "shop_id": 50, "shop_name": 255, "state": 100, "city": 100, "district": 100, "country": 10,
    "payment_method": 50, "carrier_name": 100, "cancel_reason": 500,
}

# Columns that a line must have, its amounts and its lifecycle times.
REQUIRED = ("order_id", "platform", "sku", "create_time", "order_status")
MANDATORY_AMOUNTS = ("original_price", "subtotal", "buyer_total_amount")
OPTIONAL_AMOUNTS = (
    "seller_discount", "platform_discount", "voucher_total", "commission_fee", "service_fee",
    "transaction_fee", "shipping_fee", "original_shipping", "tax_amount",
)
LIFECYCLE = ("create_time", "pay_time", "shipped_time", "completed_time", "cancel_time")

# Names of data origins and model sources.
LIVE_ORIGINS = ("unverified_warehouse", "warehouse_live")
HISTORY_ORIGIN = "public_anonymized_historical_csv"
TRAINED_SOURCES = ("mlflow_registry", "local_joblib")

# Provinces by region (names used when orders are loaded).
SOUTH = (
    "TP.HCM", "Bình Dương", "Đồng Nai", "Long An", "Cần Thơ", "Bà Rịa - Vũng Tàu", "Tây Ninh",
    "Bến Tre", "Tiền Giang", "An Giang", "Kiên Giang", "Vĩnh Long", "Trà Vinh", "Sóc Trăng",
    "Bạc Liêu", "Cà Mau", "Hậu Giang", "Đồng Tháp",
)
CENTRAL = (
    "Đà Nẵng", "Khánh Hoà", "Thừa Thiên Huế", "Quảng Nam", "Quảng Ngãi", "Bình Định", "Phú Yên",
    "Ninh Thuận", "Bình Thuận", "Gia Lai", "Đắk Lắk", "Đắk Nông", "Kon Tum", "Lâm Đồng",
    "Nghệ An", "Hà Tĩnh", "Quảng Bình", "Quảng Trị", "Thanh Hoá",
)
# The other labelling, used when the geography table is seeded.
SEED_NORTH = ("Hà Nội", "Hải Phòng", "Quảng Ninh", "Bắc Ninh", "Hải Dương", "Thái Nguyên")
SEED_CENTRAL = (
    "Đà Nẵng", "Thừa Thiên Huế", "Khánh Hòa", "Quảng Nam", "Nghệ An", "Lâm Đồng", "Khánh Hoà",
    "Thanh Hoá",
)
SEED_SOUTH = (
    "Hồ Chí Minh", "TP.HCM", "Bình Dương", "Đồng Nai", "Cần Thơ", "Long An", "Tiền Giang",
    "Bà Rịa - Vũng Tàu",
)

# Normal quantiles by service level, and the classifier's own coarser table.
SERVICE_Z = {0.80: 0.842, 0.85: 1.036, 0.90: 1.282, 0.95: 1.645, 0.98: 2.054, 0.99: 2.326}
CLASSIFIER_Z = {0.90: 1.28, 0.95: 1.65, 0.98: 2.05, 0.99: 2.33}
STABILITY_Z = {"stable": 1.645, "volatile": 1.96}

# Recommendation text per nine-box cell (strategy, model).
NINE_BOX = {
    "AX": ("Chiến lược Just-In-Time (JIT), kiểm soát tồn kho chặt chẽ, tối thiểu chi phí lưu kho.",
           "LightGBM / ARIMA / Exponential Smoothing (Độ chính xác rất cao)"),
    "AY": ("Giám sát tồn kho định kỳ, chuẩn bị đệm trước sự kiện khuyến mãi / Flash Sale.",
           "XGBoost / LightGBM tích hợp feature khuyến mãi, ngày đôi"),
    "AZ": ("Sản phẩm doanh thu cao nhưng nhu cầu biến động mạnh; cần lượng Safety Stock dự phòng cao.",
           "Deep Learning (LSTM/GRU) hoặc Mô hình tổng hợp Ensemble"),
    "BX": ("Áp dụng điểm đặt hàng lại tự động (Automated ROP), kiểm soát định kỳ vừa phải.",
           "LightGBM Baseline / Random Forest"),
    "BY": ("Dự báo theo chu kỳ mùa vụ / Flash sale, tối ưu lô đặt hàng kinh tế (EOQ).",
           "LightGBM / Prophet với đặc trưng chuỗi thời gian"),
    "BZ": ("Tồn kho theo lô nhỏ, cảnh giác nguy cơ tồn đọng vốn giá trị trung bình.",
           "XGBoost kết hợp phân loại xác suất phát sinh nhu cầu (Two-stage)"),
    "CX": ("Giá trị thấp, nhu cầu đều; áp dụng điểm đặt hàng tự động với lô lớn để giảm chi phí đặt hàng.",
           "Heuristic trung bình trượt / Moving Average"),
    "CY": ("Giá trị thấp, nhu cầu biến động; duy trì tồn kho tối thiểu, đặt hàng theo lô.",
           "Mô hình giản đơn hoặc phân tích mùa vụ đơn giản"),
    "CZ": ("Hàng đuôi dài rủi ro tồn kho cao; cân nhắc Make-to-Order hoặc Dropshipping.",
           "Phát hiện nhu cầu gián đoạn (Croston's Method) hoặc tồn kho tối thiểu"),
}
NINE_BOX_DEFAULT = ("Duy trì chính sách chuẩn", "Baseline ML")

# Heuristic demand factors (Monday first) and market seasonality by month.
WEEKDAY_FACTOR = (0.95, 0.98, 1.02, 1.00, 1.10, 1.35, 1.25)
SALE_DAY_FACTOR = 3.5
PAYDAY_FACTOR = 1.15
MARKET_MONTHS = (0.95, 0.62, 0.86, 0.97, 1.12, 1.03, 0.88, 1.16, 1.32, 1.18, 1.65, 1.5)
FLASH_HOURS = (12, 20, 21)

# Lags, windows and spans of the features, history limits, and monitored features.
DEFAULT_LAGS = (1, 2, 3, 7, 14, 21, 28)
ROLLING_WINDOWS = (7, 14, 28)
EMA_SPANS = (7, 14)
HISTORY_DAYS = 120
STATS_WINDOW_DAYS = 28
MAX_FORECAST_STEPS = 180
DRIFT_COLUMNS = (
    "lag_1", "lag_7", "rolling_mean_7", "rolling_std_7", "rolling_mean_28", "avg_unit_price",
    "total_discount", "order_count", "daily_demand",
)
