"""Fixed values of the inbox domain: stored codes, limits, labels and patterns.

Brands, the owner's name and the banned domain differ per deployment, so they
are arguments everywhere; the values here are the defaults.
"""

INBOUND = "entrada"
OUTBOUND = "saida"

PAID_STATUSES = ("APPROVED", "COMPLETE", "COMPLETED")

REPLY_BRANDS = ("brand_es", "brand_en", "brand_it")
REPLY_CHANNELS = ("dm", "comentario_publico", "comentario_privado")
OUTSIDE_CHANNELS = ("dm", "comentario")
COMMENT_CHANNELS = ("comentario", "comentario_fb")
OPERATOR_STATES = ("resolvido", "aguardando_dono", "aguardando_email")
REASON_SOURCES = ("perguntado", "espontaneo", "sem_resposta")

BRAND_LANGS = {"brand_en": "en", "brand_it": "it", "brand_de": "de"}
DEFAULT_LANG = "es"
REPLY_LANGS = {"brand_en": "en", "brand_it": "it"}  # of suggested replies, where a request names none
BRAND_NAMES = {
    "brand_es": "Brand ES",
    "brand_en": "Brand EN",
    "brand_it": "Brand IT",
    "brand_de": "Brand DE",
}
MODERATION_BRANDS = ("brand_es", "brand_en", "brand_it")

BANNED_DOMAIN = "banned-domain.example"

# fixed values: patterns
EMAIL_IN_TEXT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"
PUBLIC_LINK = r"(?i)(https?://|www\.|\.(com|online|net|org|io)\b)"
DM_REF = r"^[0-9]{10,20}$"
COMMENT_REF = r"^[0-9]{15,20}$"

# fixed values: limits
REPLY_MAX_CHARS = 1000
PUBLIC_MAX_LINES = 3
PAUSE_MAX_HOURS = 336
TOP_ACCESSES = 15
TOP_QUEUE = 10
LANGUAGE_SAMPLE = 6
TRANSCRIPT_SHORT = 30
TRANSCRIPT_LONG = 80
CORRECTIONS_READ = 40
CORRECTIONS_KEPT = 25
TRANSLATION_BATCH = 40
TRANSLATION_CHARS = 2000

# fixed values: urgency class and label, in rule order
URGENCY = (
    (8, "Resposta já na fila, sai em até 5 min"),
    (9, "Spam"),
    (7, "Só agradecimento, não precisa de resposta"),
    (1, "Fala em fraude ou estafa"),
    (1, "Comentário público parado"),
    (2, "Janela de 24h fechando"),
    (3, "Janela de 24h aberta"),
    (3, "Comentário recente"),
    (4, "Só com tag human_agent (até 7 dias)"),
    (5, "Fora das janelas: só por e-mail"),
)

# fixed values: e-mail texts per language
MAIL_TEXTS = {
    "es": {
        "subject": "Tus archivos de {marca}",
        "hello": "Hola",
        "intro": "Aquí están tus archivos, para descargar directo. No hace falta plataforma ni contraseña.",
        "note": "Estos enlaces no vencen: puedes volver a este correo cuando quieras. Aun así, guarda los PDF en tu celular o computadora.",
        "end": "Si algo no abre, responde este correo y lo resuelvo.",
        "button": "Descargar",
    },
    "en": {
        "subject": "Your {marca} files",
        "hello": "Hi",
        "intro": "Here are your files, as direct downloads. No platform, no password needed.",
        "note": "These links do not expire — you can come back to this email any time. Still, save the PDFs to your phone or computer.",
        "end": "If anything does not open, reply to this email and I will sort it out.",
        "button": "Download",
    },
    "pt": {
        "subject": "Seus arquivos de {marca}",
        "hello": "Olá",
        "intro": "Aqui estão seus arquivos, para baixar direto. Sem plataforma nem senha.",
        "note": "Os links não vencem: pode voltar a este e-mail quando quiser. Mesmo assim, salve os PDFs no celular ou no computador.",
        "end": "Se algo não abrir, responda este e-mail e eu resolvo.",
        "button": "Baixar",
    },
    "de": {
        "subject": "Deine Dateien von {marca}",
        "hello": "Hallo",
        "intro": "Hier sind deine Dateien, direkt zum Herunterladen. Keine Plattform, kein Passwort.",
        "note": "Diese Links laufen nicht ab — du kannst jederzeit zu dieser E-Mail zurückkommen. Speichere die PDFs trotzdem auf deinem Handy oder Computer.",
        "end": "Falls sich etwas nicht öffnet, antworte einfach auf diese E-Mail und ich kümmere mich darum.",
        "button": "Herunterladen",
    },
    "it": {
        "subject": "I tuoi file di {marca}",
        "hello": "Ciao",
        "intro": "Ecco i tuoi file, da scaricare direttamente. Nessuna piattaforma, nessuna password.",
        "note": "I link non scadono: puoi tornare a questa email quando vuoi. Comunque, salva i PDF sul telefono o sul computer.",
        "end": "Se qualcosa non si apre, rispondi a questa email e lo risolvo.",
        "button": "Scarica",
    },
}

# fixed values: wording of transcripts and of the lines of a file
WORDS = {
    "customer": "CLIENTE",
    "us": "NÓS",
    "internal": "REGISTRO INTERNO",
    "media_unknown": "[mídia sem texto: imagem, print ou áudio; conteúdo desconhecido]",
    "media": "[mídia sem texto]",
    "empty": "[vazio]",
    "deleted": " (comentário apagado)",
    "hidden": " (comentário oculto)",
    "paid": "PAGA",
    "never_used": "nunca baixou",
    "guided": "já recebeu o passo a passo",
    "not_guided": "AINDA NÃO recebeu o passo a passo",
    "never_entered": "nunca entrou",
    "not_paused": "não",
    "delivered": "entregue pela Resend",
    "by_bot": "pelo robô",
    "by_owner": "à mão por {owner}",
    "no_emails": "nenhum",
    "no_purchases": "- nenhuma compra encontrada para os e-mails conhecidos",
    "no_items": "- nenhum (sem compra paga ou sem cadastro)",
    "no_deliveries": "- nenhum envio registrado por aqui (pode ter recebido só o e-mail automático da Hotmart)",
    "no_refunds": "nenhum pedido",
    "no_messages": "(sem mensagens gravadas)",
    "no_draft": "(vazio)",
}

# fixed values: forms of the lines
LINES = {
    "reply_message": "[{at} · {channel}{category}] {who}: {text}",
    "summary_message": "[{at} {channel}{category}] {who}: {text}{removed}",
    "purchase": "- {status} · {product} · {amount} {currency} · transação {transaction} · {day} · e-mail {email}{payment}",
    "item": "- {title} ({brand}) · {used}",
    "used": "baixou em {day}",
    "refund": "pedido em {day} · {transactions} · motivo: {reason} · {guided}",
    "state": "{state}{email} · tentativas {attempts}",
    "state_email": " · e-mail informado {email}",
    "pause": "até {until} ({reason})",
    "delivery": "- {day} · para {to} · {n} arquivo(s): {files} · {result} · enviado {by}",
    "more_files": "{first} e mais {n}",
    "failed": "FALHOU: {result}",
    "correction": "- {rule_mark}{asked}{rule}{pair}",
    "rule_mark": "[REGRA] ",
    "asked": 'ele pediu: "{instruction}"',
    "rule": " → regra: {rule}",
    "pair": "\n    antes: {before}\n    depois: {after}",
    "fact": "- [{topic}] {text}",
}

# fixed values: the text that a summary is made from, its lines, and what stands for nothing
SUMMARY_CASE = (
    "MARCA: {brand}\nCOMPRAS: {purchases}\nE-MAILS COM ARQUIVOS: {deliveries}\nESTADO NO FLUXO: {state}\n\n"
    "CONVERSA (cronológica, {n} mensagens):\n{transcript}"
)
SUMMARY_LINES = {
    "purchase": "{status} {product} {day} {transaction}",
    "delivery": "{at} para {to} ({n} arq, {result})",
    "state_email": " · e-mail {email}",
    "no_purchases": "nenhuma compra encontrada",
    "no_deliveries": "nenhum e-mail com arquivos enviado por nós",
    "no_state": "nunca entrou no fluxo de acesso",
}
NO_FACTS, NO_CORRECTIONS = "(vazio)", "(nenhuma ainda)"

# fixed values: the case text
CHANNEL_TEXTS = {
    "dm": "DM (mensagem direta)",
    "comentario_publico": "COMENTÁRIO PÚBLICO (3 linhas, sem link, outros leem)",
}
PRIVATE_TEXT = "RESPOSTA PRIVADA ao comentário (chega como DM)"
CASE_TEXT = """CASO
- Marca: {brand}
- Canal da resposta: {channel}
- Idioma do cliente (detectado): {lang}
- Situação: {situation}{window}
- Categorias detectadas pelo bot: {categories}
{target}
FICHA
- E-mails conhecidos (mascarados): {emails}
- Compras ({n_paid} paga(s) de {n_purchases}):
{purchases}
- Arquivos a que tem direito:
{items}
- ENTREGAS JÁ FEITAS por e-mail ({n_delivered} entregue(s) de {n_deliveries} tentativa(s)):
{deliveries}
{last}
- Logins na biblioteca antiga: {n_logins} · downloads: {n_downloads}
- Estado no fluxo automático: {state}
- Bot pausado: {pause}
- Reembolso: {refunds}"""
CASE_TARGET = "- Comentário que está sendo respondido: {target}\n"
CASE_LAST = (
    "- RESUMO PARA USAR NA RESPOSTA: os arquivos foram enviados em {day} para {to}. "
    "Se ele disser que não recebeu, é este dia e este e-mail que você cita (regra 15)."
)
CASE_NO_LAST = (
    "- Nenhuma entrega registrada: se ele tem compra paga e diz que não recebeu, o caminho é reenviar, não citar data."
)
CASE_TALK = "\n\nCONVERSA (cronológica, últimas {n})\n{transcript}\n"
CASE_WRITE = "\nEscreva a resposta para este caso."
CASE_IMPROVE = (
    "\nRASCUNHO ATUAL (o que está na caixa de resposta):\n{draft}\n\n"
    'INSTRUÇÃO DE {owner} (ditada ou escrita, pode estar informal):\n"{instruction}"\n'
)

# fixed values: records of actions
RECORDS = {
    "origin": "tela:{by}",
    "pause": "humano atendendo pela tela ({by})",
    "refund": "registrado pela tela por {by}",
    "outside": "[respondido à mão no Instagram por {by}]{note}",
    "delete": '[respondido à mão por {by}] comentário apagado pela tela: "{text}"',
    "hide": '[à mão por {by}] comentário ocultado pela tela: "{text}"',
    "show": '[à mão por {by}] comentário reexibido pela tela: "{text}"',
    "links": "links de arquivos liberados por confirmação manual: {reason}",
    "mail": "e-mail com arquivos enviado por confirmação manual: {reason}",
    "no_email": "(sem e-mail)",
    "default_topic": "geral",
    "not_json": "A IA não devolveu JSON; texto bruto acima.",
}
