"""Run settings. The defaults are fixed values that results depend on."""

from __future__ import annotations

from types import SimpleNamespace

# Settings of a run, the tasks that have them (none named: all), the default.
SETTINGS = [
    ("seed", (), 42),
    ("parallelism", (), 4),
    ("top_n_models", (), 90),
    ("test_size", ("classification", "regression"), 0.25),
    ("cv_folds", ("classification", "regression"), 3),
    ("n_iter", ("classification", "regression"), 25),
    ("use_class_weights", ("classification",), True),
    ("imbalance_threshold", ("classification",), 0.5),
    ("skew_threshold", ("regression",), 1.0),
    ("n_trials", ("clustering",), 25),
    ("stability_n_runs", ("clustering",), 8),
    ("stability_sample_frac", ("clustering",), 0.8),
    ("gap_n_refs", ("clustering",), 5),
    ("eval_space", ("clustering",), "view"),
]


def settings(task: str, **changes) -> SimpleNamespace:
    """The settings of a task with some of them changed; unknown names are refused."""
    values = {name: default for name, tasks, default in SETTINGS if not tasks or task in tasks}
    unknown = changes.keys() - values.keys()
    if unknown:
        raise TypeError(f"{task} has no setting {', '.join(sorted(unknown))}")
    return SimpleNamespace(**{**values, **changes})


# Feature limits.
LOW_CARDINALITY_MAX = 50
HASH_SLOTS = 128
WIDE_LIMIT = 100
WIDE_LIMIT_CLUSTERING = 50
SVD_COMPONENTS = 50

# Progress steps by index.
PROGRESS_STEPS = {
    0: "Загрузка данных",
    1: "Оценка базовых моделей",
    2: "Настройка гиперпараметров",
    3: "Расчет метрик",
    4: "Визуализация результатов",
    5: "Сохранение моделей",
    6: "Завершено",
}

# Seconds before an entry counts as gone.
ACTIVE_DATASET_TTL = 15 * 60
PROGRESS_TTL = 2 * 60 * 60
