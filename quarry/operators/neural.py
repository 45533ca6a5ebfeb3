"""Multilayer perceptrons and a restricted Boltzmann machine (numpy kernels, scored on Arrow batches)."""

from __future__ import annotations

import numpy as np

from quarry.operators.base import ArrayEstimator, Classifier, Regressor, Transformer, classes_of, r2

_ACT = {
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "logistic": (lambda z: 1 / (1 + np.exp(-z)), lambda a: a * (1 - a)),
    "identity": (lambda z: z, np.ones_like),
}
_MLP = {
    "hidden_layer_sizes": (100,), "activation": "relu", "solver": "adam", "alpha": 1e-4, "batch_size": "auto", "learning_rate": "constant", "learning_rate_init": 1e-3, "power_t": 0.5,
    "max_iter": 200, "shuffle": True, "tol": 1e-4, "momentum": 0.9, "nesterovs_momentum": True, "early_stopping": False, "validation_fraction": 0.1, "beta1": 0.9, "beta2": 0.999, "epsilon": 1e-8, "n_iter_no_change": 10, "random_state": 0,
}


class _MLPBase(ArrayEstimator):
    params = dict(_MLP)

    def _forward(self, x):
        out = [x]
        f = _ACT[self.activation][0]
        for k, (w, b) in enumerate(zip(self.weights_, self.biases_, strict=True)):
            z = out[-1] @ w + b
            out.append(f(z) if k < len(self.weights_) - 1 else self._output(z))
        return out

    def _gradients(self, x, y):
        acts = self._forward(x)
        d = (acts[-1] - y) / len(x)
        gw, gb = [None] * len(self.weights_), [None] * len(self.weights_)
        for k in range(len(self.weights_) - 1, -1, -1):
            gw[k] = acts[k].T @ d + self.alpha * self.weights_[k] / len(x)
            gb[k] = d.sum(axis=0)
            if k:
                d = d @ self.weights_[k].T * _ACT[self.activation][1](acts[k])
        loss = self._loss(acts[-1], y) + 0.5 * self.alpha * sum((w * w).sum() for w in self.weights_) / len(x)
        return loss, gw + gb

    def _train(self, x, y):
        rng = np.random.default_rng(self.random_state)
        sizes = [x.shape[1], *self.hidden_layer_sizes, y.shape[1]]
        self.weights_, self.biases_ = [], []
        for a, b in zip(sizes[:-1], sizes[1:], strict=True):
            bound = np.sqrt((2.0 if self.activation == "logistic" else 6.0) / (a + b))
            self.weights_.append(rng.uniform(-bound, bound, (a, b)))
            self.biases_.append(rng.uniform(-bound, bound, b))
        hold = None
        if self.early_stopping:
            order = rng.permutation(len(x))
            k = max(1, int(self.validation_fraction * len(x)))
            hold, x, y = (x[order[:k]], y[order[:k]]), x[order[k:]], y[order[k:]]
        size = min(200, len(x)) if self.batch_size == "auto" else min(self.batch_size, len(x))
        every = self.weights_ + self.biases_
        first, second = [np.zeros_like(p) for p in every], [np.zeros_like(p) for p in every]
        rate, t, best, idle, kept = self.learning_rate_init, 0, np.inf, 0, None
        self.loss_curve_ = []
        for _ in range(self.max_iter):
            order = rng.permutation(len(x)) if self.shuffle else np.arange(len(x))
            total = 0.0
            for s in range(0, len(x), size):
                who = order[s : s + size]
                loss, grads = self._gradients(x[who], y[who])
                total += loss * len(who)
                t += 1
                for p, g, m, v in zip(every, grads, first, second, strict=True):
                    if self.solver == "adam":
                        m += (1 - self.beta1) * (g - m)
                        v += (1 - self.beta2) * (g * g - v)
                        p -= rate * np.sqrt(1 - self.beta2**t) / (1 - self.beta1**t) * m / (np.sqrt(v) + self.epsilon)
                    else:
                        m *= self.momentum
                        m -= rate * g
                        p += self.momentum * m - rate * g if self.nesterovs_momentum else m
                if self.learning_rate == "invscaling" and self.solver == "sgd":
                    rate = self.learning_rate_init / t**self.power_t
            self.loss_curve_.append(total / len(x))
            value = -self._validate(*hold) if hold else self.loss_curve_[-1]
            idle = idle + 1 if value > best - self.tol else 0
            if value < best:
                best = value
                if hold:
                    kept = [p.copy() for p in every]
            if idle >= self.n_iter_no_change:
                if self.learning_rate == "adaptive" and self.solver == "sgd" and rate > 1e-6:
                    rate, idle = rate / 5, 0
                else:
                    break
        if kept:
            for p, q in zip(every, kept, strict=True):
                p[...] = q


class MLPClassifier(Classifier, _MLPBase):
    def fit_arrays(self, x, y, w=None):
        self.classes_, at = classes_of(y)
        k = len(self.classes_)
        self._train(x, (at[:, None] == 1).astype(float) if k == 2 else np.eye(k)[at])
        return self

    def _output(self, z):
        if z.shape[1] == 1:
            return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _loss(self, p, y):
        p = np.clip(p, 1e-15, 1 - 1e-15)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p) if p.shape[1] == 1 else y * np.log(p)).sum() / len(p)

    def _validate(self, x, y):
        p = self._forward(x)[-1]
        return float(((p > 0.5) == y).mean() if p.shape[1] == 1 else (p.argmax(axis=1) == y.argmax(axis=1)).mean())

    def proba_arrays(self, x):
        p = self._forward(x)[-1]
        return np.column_stack([1 - p, p]) if p.shape[1] == 1 else p


class MLPRegressor(Regressor, _MLPBase):
    def fit_arrays(self, x, y, w=None):
        self._train(x, y.reshape(len(y), -1))
        return self

    def _output(self, z):
        return z

    def _loss(self, p, y):
        return ((p - y) ** 2).sum() / 2 / len(p)

    def _validate(self, x, y):
        return r2(y[:, 0], self._forward(x)[-1][:, 0])

    def predict_arrays(self, x):
        return self._forward(x)[-1][:, 0]


class BernoulliRBM(Transformer, ArrayEstimator):
    """One-step contrastive divergence on contiguous batches."""

    params = {"n_components": 256, "learning_rate": 0.1, "batch_size": 10, "n_iter": 10, "random_state": 0}

    def _hidden(self, v):
        return 1 / (1 + np.exp(-(v @ self.components_.T + self.hidden_bias_)))

    def _visible(self, h):
        return 1 / (1 + np.exp(-(h @ self.components_ + self.visible_bias_)))

    def partial_arrays(self, v):
        h0 = self._hidden(v)
        v1 = (self._rng.random(v.shape) < self._visible((self._rng.random(h0.shape) < h0).astype(float))).astype(float)
        h1 = self._hidden(v1)
        r = self.learning_rate / len(v)
        self.components_ += r * (h0.T @ v - h1.T @ v1)
        self.hidden_bias_ += r * (h0 - h1).sum(axis=0)
        self.visible_bias_ += r * (v - v1).sum(axis=0)
        return self

    def fit_arrays(self, x, y=None, w=None):
        self._rng = np.random.default_rng(self.random_state)
        self.components_ = self._rng.uniform(-0.05, 0.05, (self.n_components, x.shape[1]))
        self.hidden_bias_, self.visible_bias_ = np.zeros(self.n_components), np.zeros(x.shape[1])
        for _ in range(self.n_iter):
            for s in range(0, len(x), self.batch_size):
                self.partial_arrays(x[s : s + self.batch_size])
        del self._rng
        return self

    def gibbs(self, v, rng=None):
        rng = rng or np.random.default_rng(self.random_state)
        h = self._hidden(v)
        return (rng.random(v.shape) < self._visible((rng.random(h.shape) < h).astype(float))).astype(float)

    def transform_arrays(self, x):
        return self._hidden(x)
